"""Hostile lines, payloads of several or broken parts, ids that are texts, items in blocks."""

import gzip

import pytest

from mnemora.llm import decontaminate, quality_rules, warc


def doubling(n):
    """The first n letters of the Thue-Morse sequence over a and b, and of its complement: sums of powers of any odd base agree."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [256, 512, 1024, 4096])
def test_unequal_lines_are_no_duplicates(spark, n):
    one, other = doubling(n)
    docs = spark.createDataFrame([(1, f"{one}\n{other}\n{one}"), (2, " ".join([one, other] * 8))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got[1].n_dup_lines == 1 and got[1].n_removed_lines <= 1
    assert got[2].n_repeat_words == 16  # the windows at 0 and 2, 1 and 3, ... are equal, those of other parity are not


def record(payload, coding="gzip"):
    http = f"HTTP/1.1 200 OK\r\nContent-Encoding: {coding}\r\n\r\n".encode()
    head = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", warc.DATE), ("Content-Type", "application/http; msgtype=response")]
    return warc.write_record(head, http + payload)


def shown(spark, payload, coding="gzip"):
    rows = warc.read_images(warc.write_images(spark.createDataFrame([("a page", bytearray(record(payload, coding)))], "page_id string, record binary"))).collect()
    assert {r.page_id for r in rows} == {"a page"}
    return {r.type: (r.error or warc.read_record(bytes(r.record))[1].decode()) for r in rows}


def test_compressed_payloads_are_whole_or_an_error(spark, monkeypatch):
    page = b"".join(b"<p>words of page %d" % k for k in range(3000))
    packed = gzip.compress(page)
    assert "words of page 2999" in shown(spark, packed)["conversion"]
    assert shown(spark, packed[: len(packed) // 2]).keys() == {"error"} and "ends early" in shown(spark, packed[:-4])["error"]
    halves = gzip.compress(page[:30_000]) + gzip.compress(page[30_000:])
    assert shown(spark, halves)["conversion"] == shown(spark, packed)["conversion"]
    assert shown(spark, halves + b"\0\0")["conversion"] == shown(spark, packed)["conversion"]
    assert "not the encoding" in shown(spark, packed + b"rest")["error"] and "not the encoding" in shown(spark, page)["error"]
    with pytest.raises(ValueError, match="unfolds to more"):
        warc.unfolded(gzip.compress(bytes(2000)), 31, most=1999)
    assert len(warc.unfolded(gzip.compress(bytes(2000)), 31, most=2000)) == 2000


def test_text_ids_and_blocks_of_items(spark):
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([("d1", " ".join(words)), (None, " ".join(words[100:200]))], "doc_id string, text string")
    items = spark.createDataFrame([(f"i{k}", " ".join(words[10 * k : 10 * k + 12])) for k in range(30)] + [(None, "w1 w2 w3")], "item_id string, text string")
    shown = lambda df: sorted(((r.doc_id or "", r.item_id or "", r.n_shingles, r.containment) for r in df.collect()))
    whole = shown(decontaminate.search(docs, items))
    assert {i for d, i, *_ in whole if d == "d1"} == {f"i{k}" for k in range(30)} | {""}
    assert shown(decontaminate.search(docs, items, most=40)) == whole
