"""What is pushed instead of pulled: signed webhooks, uploads, checkouts, inventories of log platforms, wiki pages."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import files, manifests
from .registry import RETRY_STATUS, TransientError, with_retry

UPLOADS = "uploads:uploads"
PAGE = "id string, type string, title string, body string, webui string, version long, updated_at string"
#: Lines of an inventory that one document lists.
MOST_LISTED = 200


def signed(secret: str, body: bytes, headers: dict[str, str], token: str | None = None, own_header: str = "x-webhook-signature") -> bool:
    """Whether a webhook carries its secret: a signature of its body, the secret as a header, or as a token; the first that is there decides. own_header: where senders without a convention put the signature."""
    own = hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    low = {k.lower(): v for k, v in headers.items()}
    for name, want in (("x-hub-signature-256", f"sha256={own}"), ("x-gitlab-token", secret), (own_header.lower(), own)):
        if low.get(name):
            return hmac.compare_digest(low[name], want)
    return bool(token) and hmac.compare_digest(token, secret)


@dataclass
class Hook:
    """A source's webhook: a payload becomes documents, or calls for a sync of the whole source."""

    secret: str | None
    documents: Callable[[dict], DataFrame | None]
    wants_resync: Callable[[dict], bool] = lambda payload: False

    def receive(self, body: bytes, headers: dict[str, str], ingest: Callable[[DataFrame], object], resync: Callable[[], object], token: str | None = None):
        """(status, result): 403 without a secret or with a wrong signature, 400 for what is no JSON, else 200."""
        import json

        if not self.secret:
            return 403, "no secret is set for this source"
        if not signed(self.secret, body, headers, token):
            return 403, "the signature does not match"
        try:
            payload = json.loads(body)
        except ValueError:
            return 400, "the body is no JSON"
        if self.wants_resync(payload):
            return 200, resync()
        found = self.documents(payload)
        return 200, ingest(found) if found is not None else None


def branch_pushed(branch: str | None) -> Callable[[dict], bool]:
    """A git push to the branch that is read (any, where none is named) calls for a sync."""
    return lambda payload: "ref" in payload and (branch is None or str(payload["ref"]) == f"refs/heads/{branch}")


def stored_uploads(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files (name, content) after uploads: the same bytes under a name change nothing, others get a name of their own."""
    named = new.select(text.upload_name(F.col("name")).alias("name"), "content", F.sha2("content", 256).alias("digest")).dropDuplicates(["name", "digest"])
    # Of new files of one name the first by content keeps it, if no stored one has it.
    there = old.select("name", F.sha2("content", 256).alias("held"))
    first = named.groupBy("name").agg(F.min("digest").alias("first"))
    placed = named.join(first, "name").join(there, "name", "left").withColumn("owner", F.coalesce("held", "first"))
    kept = placed.where("digest <> owner or held is null")
    return old.select("name", "content").union(kept.select(F.when(F.col("digest") == F.col("owner"), F.col("name")).otherwise(text.distinct_upload_name(F.col("name"), F.col("digest"))).alias("name"), "content"))


def checkout(remote: str, folder: str, branch: str | None = None, depth: int = 200, run: Callable = subprocess.run) -> None:
    """Clones a repository, or pulls what is new."""
    if os.path.isdir(os.path.join(folder, ".git")):
        command = ["git", "-C", folder, "pull", "--ff-only"]
    else:
        command = ["git", "clone", "--depth", str(depth), *(["--branch", branch] if branch else []), remote, folder]
    done = run(command, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git failed: {done.stderr.strip()[:500]}")


def repository(spark: SparkSession, folder: str, url: str, name: str) -> DataFrame:
    """uri, title, kind, text, updated_at of a checkout's files, and its map of dependencies."""
    root = folder.rstrip("/")
    relative = F.regexp_replace("uri", rf"^[a-z]+:/*{re.escape(root.lstrip('/'))}/", "")
    read = files.read_tree(spark, root).withColumn("relative", relative)
    docs = read.select(F.concat(F.lit(f"{url}::"), "relative").alias("uri"), F.col("relative").alias("title"), "kind", "text", F.col("updated_at").cast("string").alias("updated_at"))
    scanned = manifests.scan(read.select(F.col("relative").alias("path"), "text"))
    page = manifests.map_document(scanned, name, url).withColumn("updated_at", F.lit(None).cast("string"))
    return docs.unionByName(page.select("uri", "title", "kind", "text", "updated_at"))


def wiki_documents(pages: DataFrame, base: str) -> DataFrame:
    """uri, title, kind, text, updated_at of rendered wiki pages (see PAGE); pages without text are left out."""
    from .pages import parsed

    uri = F.concat(F.lit(base.rstrip("/")), "webui")
    return pages.select(uri.alias("uri"), "title", F.lit("doc").alias("kind"), parsed(uri, F.col("body"))["text"].alias("text"), "updated_at").where("trim(text) <> ''")


def inventory_document(rows: DataFrame, uri: str, title: str, line: Column) -> DataFrame:
    """One document that lists what a platform has (dashboards, indices, data sources), sorted; none without rows. Lists of over MOST_LISTED lines go on in further documents."""
    listed = rows.select(line.alias("line")).where("line is not null").distinct()
    placed = listed.withColumn("part", F.expr(f"cast((row_number() over (order by line) - 1) div {MOST_LISTED} as int)"))
    grouped = placed.groupBy("part").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "line"))), "\n").alias("said"))
    suffix = F.when(F.col("part") > 0, F.concat(F.lit("#"), F.col("part").cast("string"))).otherwise("")
    return grouped.select(F.concat(F.lit(uri), suffix).alias("uri"), F.lit(title).alias("title"), F.lit("doc").alias("kind"), F.concat(F.lit(f"# {title}\n\n"), "said", F.lit("\n")).alias("text"))


def item_documents(rows: DataFrame, uri: Column, title: Column, fields: dict[str, Column]) -> DataFrame:
    """One document for each monitor or problem: its fields, a line each."""
    lines = F.concat_ws("\n", *[F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in fields.items()])
    return rows.select(uri.alias("uri"), title.alias("title"), F.lit("doc").alias("kind"), F.concat(F.lit("# "), title, F.lit("\n\n"), lines, F.lit("\n")).alias("text"))


def read_workers(name: str = "MNEMORA_READ_WORKERS", cpus: int | None = None) -> int:
    """How many reads go on at once: what the environment says, else as many as there are cores, at most eight; from 1 to 64."""
    said = os.environ.get(name, "")
    wanted = int(said) if said.lstrip("-").isdigit() else min(8, cpus or os.cpu_count() or 1)
    return max(1, min(64, wanted))


@dataclass
class Fetcher:
    """How pages are fetched: a pause between two of a host, retries, robots rules, another way for pages that need scripts.

    get(url) gives (status, body); render(url), where there is one, the body of a page whose own was empty.
    """

    get: Callable[[str], tuple[int, str]]
    pause: float = 1.0
    render: Callable[[str], str] | None = None
    agent: str = "mnemora"
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)
    rules: dict[str, object] = field(default_factory=dict)

    def allowed(self, url: str) -> bool:
        """What the host's robots.txt says, read once; where there is none, everything is allowed."""
        from urllib.robotparser import RobotFileParser

        parts = urlsplit(url)
        host = f"{parts.scheme}://{parts.netloc}"
        if host not in self.rules:
            rules = RobotFileParser()
            try:
                status, body = self.get(f"{host}/robots.txt")
            except (OSError, TransientError):
                status, body = 0, ""
            rules.parse(body.splitlines() if status == 200 else [])
            self.rules[host] = rules
        return self.rules[host].can_fetch(self.agent, url)

    def fetch(self, url: str) -> str | None:
        """A page's body; None where the rules forbid it or it is not there."""
        if not self.allowed(url):
            return None
        host = urlsplit(url).netloc

        def once() -> tuple[int, str]:
            wait = self.last.get(host, -1e9) + self.pause - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last[host] = self.clock()
            status, body = self.get(url)
            if status in RETRY_STATUS:
                raise TransientError(f"{url}: {status}")
            return status, body

        status, body = with_retry(once, sleep=self.sleep)
        if status != 200:
            return None
        return self.render(url) if self.render is not None and not re.sub(r"<[^>]+>|\s", "", body) else body
