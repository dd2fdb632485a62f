"""Assertions in connectors' items: work items, issues, merge requests, builds, deployments, drives.

Items are rows with typed, nested columns (as from_json with the schemas here gives
them); every extractor is a projection and an explode to (src, rel, dst, detail).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORK_ITEM = "id long, type string, relations array<struct<rel: string, url: string, name: string>>"
ISSUE = "key string, summary string, parent string, links array<string>"
MERGE_REQUEST = "repo string, iid long, title string, source_branch string"
ITERATION = "team string, path string, start_date timestamp, finish_date timestamp, time_frame string"
DRIVE_ITEM = "drive_id string, item_id string, name string, size long, folder boolean, deleted boolean, parent_path string, modified_at timestamp"
PARENT, CHILD, RELATED = "System.LinkTypes.Hierarchy-Reverse", "System.LinkTypes.Hierarchy-Forward", "System.LinkTypes.Related"
CONTAINERS = ("epic", "feature")
IMAGE, READABLE = ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"), ("md", "txt", "csv", "json", "docx", "pptx", "xlsx", "pdf", "html", "htm", "zip")
MAX_ITEM = 30_000_000


def ticket(number: Column) -> Column:
    return F.concat(F.lit("ticket:#"), number.cast("string"))


def work_item_links(items: DataFrame, repos: DataFrame) -> DataFrame:
    """Work items to their parents, related items, repositories and branches; repos: guid, name. Links to unknown repositories are dropped."""
    each = items.where("id is not null").select("id", F.explode("relations").alias("r"))
    other = F.regexp_extract(F.rtrim("r.url", F.lit("/")), r"/(\d+)$", 1)
    rel = F.when(F.col("r.rel") == PARENT, "part_of").when(F.col("r.rel") == RELATED, "related_to")
    tickets = each.where(rel.isNotNull() & (other != "")).select(ticket(F.col("id")).alias("src"), rel.alias("rel"), ticket(other).alias("dst"), F.when(rel == "part_of", "parent work item").otherwise("related work item").alias("detail"))
    # vstfs:///Git/<kind>/<project>%2F<repo guid>%2F<rest>
    url = F.url_decode("r.url")
    parts = each.where("r.rel = 'ArtifactLink'").select("id", "r.name", F.lower(F.regexp_extract(url, "(?i)^vstfs:///Git/([A-Za-z]+)/", 1)).alias("kind"), F.lower(F.regexp_extract(url, "(?i)^vstfs:///Git/[A-Za-z]+/[^/]+/([^/]+)/", 1)).alias("guid"), F.regexp_extract(url, "(?i)^vstfs:///Git/[A-Za-z]+/[^/]+/[^/]+/(.+)$", 1).alias("rest"))
    named = parts.where("kind <> '' and guid <> ''").join(repos.select(F.lower("guid").alias("guid"), F.col("name").alias("repo")), "guid")
    label = F.coalesce("name", "kind")
    repo = F.concat(F.lit("repo:"), F.lower("repo"))
    to_repo = named.select(ticket(F.col("id")).alias("src"), F.lit("implemented_in").alias("rel"), repo.alias("dst"), F.concat(label, F.lit(": "), F.substring("rest", 1, 40)).alias("detail"))
    branch = F.concat(F.lit("branch:"), F.lower("repo"), F.lit("/"), F.lower(F.expr("substr(rest, 3)")))
    on = named.where("kind = 'ref' and startswith(rest, 'GB') and length(rest) > 2")
    to_branch = on.select(ticket(F.col("id")).alias("src"), F.lit("on_branch").alias("rel"), branch.alias("dst"), F.concat(label, F.lit(" in "), "repo").alias("detail"))
    belongs = on.select(branch.alias("src"), F.lit("belongs_to").alias("rel"), repo.alias("dst"), F.concat(F.lit("branch of "), "repo").alias("detail"))
    return once(tickets.union(to_repo).union(to_branch).union(belongs))


def once(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "rel", "dst").agg(F.min("detail").alias("detail"))


def next_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """id: what to fetch next: every item's parent, and the children of epics and features, that are not seen."""
    each = items.select(F.lower(F.trim("type")).alias("type"), F.explode("relations").alias("r"))
    wanted = each.where((F.col("r.rel") == PARENT) | ((F.col("r.rel") == CHILD) & F.col("type").isin(*CONTAINERS)))
    return wanted.select(F.regexp_extract(F.rtrim("r.url", F.lit("/")), r"/(\d+)$", 1).cast("long").alias("id")).where("id is not null").distinct().join(seen.select("id"), "id", "left_anti")


def issue_links(issues: DataFrame) -> DataFrame:
    """Issues to their project, parent and linked issues."""
    src = F.concat(F.lit("ticket:"), F.lower("key"))
    targets = F.array_compact(F.concat(
        F.array(F.struct(F.lit("part_of").alias("rel"), F.concat(F.lit("project:"), F.lower(F.substring_index("key", "-", 1))).alias("dst"), F.substring(F.coalesce("summary", F.lit("")), 1, 80).alias("detail"))),
        F.array(F.when(F.col("parent").isNotNull(), F.struct(F.lit("part_of").alias("rel"), F.concat(F.lit("ticket:"), F.lower("parent")).alias("dst"), F.lit("epic/parent").alias("detail")))),
        F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda k: F.struct(F.lit("related_to").alias("rel"), F.concat(F.lit("ticket:"), F.lower(k)).alias("dst"), F.lit("linked issue").alias("detail"))),
    ))
    return once(issues.select(src.alias("src"), F.explode(targets).alias("t")).select("src", "t.rel", "t.dst", "t.detail"))


def merge_request_links(requests: DataFrame, ticket_pattern: str | None = None) -> DataFrame:
    """Merge requests to repository and branch; with a pattern (group 1 is the number), also to the ticket that branch or title names."""
    repo = F.concat(F.lit("repo:"), F.lower("repo"))
    mr = F.concat(F.lit("merge_request:"), F.lower("repo"), F.lit("/!"), F.col("iid").cast("string"))
    name = F.trim(F.coalesce("source_branch", F.lit("")))
    branch = F.when(name != "", F.concat(F.lit("branch:"), F.lower("repo"), F.lit("/"), F.lower(name)))

    def edge(src: Column, rel: str, dst: Column) -> Column:
        return F.when(src.isNotNull() & dst.isNotNull(), F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst")))

    found = [edge(mr, "in_repo", repo), edge(mr, "from_branch", branch), edge(branch, "belongs_to", repo)]
    if ticket_pattern:
        number = F.coalesce(*[F.nullif(F.regexp_extract(c, ticket_pattern, 1), F.lit("")) for c in (name, F.coalesce("title", F.lit("")))])
        t = F.when(number.isNotNull(), F.concat(F.lit("ticket:#"), number))
        found += [edge(mr, "implements", t), edge(branch, "for_ticket", t)]
    kept = requests.where("iid is not null and coalesce(repo, '') <> ''")
    return kept.select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.src", "e.rel", "e.dst").distinct()


def build_links(definitions: DataFrame) -> DataFrame:
    """Pipelines (name, repo, branch) to the repositories they build."""
    return definitions.where("coalesce(repo, '') <> ''").select(F.concat(F.lit("pipeline:"), F.lower("name")).alias("src"), F.lit("builds").alias("rel"), F.concat(F.lit("repo:"), F.lower("repo")).alias("dst"), F.concat_ws(" ", F.lit("default branch"), F.replace("branch", F.lit("refs/heads/"), F.lit(""))).alias("detail")).distinct()


def deployment_links(items: DataFrame, projects: DataFrame, environments: DataFrame) -> DataFrame:
    """Services (items: project_id, environment_id, version, state) to the environments they are in; projects, environments: id, name."""
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    e = environments.select(F.col("id").alias("environment_id"), F.col("name").alias("environment"))
    named = items.join(p, "project_id").join(e, "environment_id").where("project <> '' and environment <> ''")
    return named.select(F.concat(F.lit("service:"), F.lower("project")).alias("src"), F.lit("deploys").alias("rel"), F.concat(F.lit("environment:"), F.lower("environment")).alias("dst"), F.concat_ws(" — ", F.coalesce("version", F.lit("?")), F.coalesce("state", F.lit("?"))).alias("detail"))


def changed_items(items: DataFrame, events: DataFrame, since: str | None) -> DataFrame:
    """Items (project_id) of projects with an event (project_id, at) since the watermark; all without one."""
    return items if since is None else items.join(events.where(F.col("at") >= F.lit(since)).select("project_id").distinct(), "project_id", "left_semi")


def recent_iterations(iterations: DataFrame, count: int) -> DataFrame:
    """Each team's last `count` dated iterations that are not in the future (all dated ones where none has begun); all with count <= 0."""
    dated = iterations.where("start_date is not null").withColumn("ahead", F.lower(F.coalesce("time_frame", F.lit(""))) == "future")
    begun = F.max(~F.col("ahead")).over(Window.partitionBy("team"))
    kept = dated.withColumn("begun", begun).where(~F.col("ahead") | ~F.col("begun")).drop("ahead", "begun")
    if count <= 0:
        return kept
    return kept.withColumn("__n", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("start_date"), F.desc("path")))).where(F.col("__n") <= count).drop("__n")


def dormant_teams(iterations: DataFrame, now: Column, days: int) -> DataFrame:
    """team: those whose newest iteration ended more than `days` ago; none with days <= 0."""
    newest = iterations.groupBy("team").agg(F.max_by("finish_date", "start_date").alias("finish"))
    return newest.where(F.lit(days > 0) & (F.date_diff(now, "finish") > days)).select("team")


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Drive items of both, the newest of each (drive_id, item_id)."""
    both = old.unionByName(new)
    return both.groupBy("drive_id", "item_id").agg(F.max_by(F.struct(*both.columns), F.coalesce("modified_at", F.lit("1970-01-01").cast("timestamp"))).alias("r")).select("r.*")


def skip_reason(items: DataFrame) -> DataFrame:
    """Adds reason: why an item is not read; null if it is."""
    e = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(F.coalesce("deleted", F.lit(False)), "deleted")
        .when(F.coalesce("folder", F.lit(False)), "folder")
        .when(F.coalesce("name", F.lit("")) == "", "unnamed")
        .when(e.isin(*IMAGE), "image")
        .when(~e.isin(*READABLE), F.concat(F.lit("unsupported type ("), F.when(e == "", "no extension").otherwise(e), F.lit(")")))
        .when(F.col("size") > MAX_ITEM, F.lit(f"larger than {MAX_ITEM // 1_000_000} MB"))
    )
    return items.withColumn("reason", reason)


def folder_path(parent_path: Column) -> Column:
    """Folder of a drive item, '' at the root."""
    return F.trim(F.coalesce(F.when(F.contains(parent_path, F.lit(":")), F.regexp_replace(parent_path, "^[^:]*:", "")).otherwise(parent_path), F.lit("")), F.lit("/"))


BLOCKS = ("paragraph", "heading", "listItem", "codeBlock", "blockquote", "rule", "tableRow")


@F.pandas_udf(T.StringType())
def rich_text(document: pd.Series) -> pd.Series:
    """Plain text of an issue tracker's JSON document: its text nodes in order, a line for each block. Other texts stay as they are; a tree may nest to any depth, which no fixed schema can say."""

    def plain(said):
        try:
            tree = json.loads(said)
        except (TypeError, ValueError, RecursionError):
            return said
        out, todo = [], [tree]
        while todo:  # reading order; a string on the stack is what ends a block
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, list):
                todo += reversed(node)
            elif isinstance(node, dict):
                kind = node.get("type")
                if kind == "hardBreak" or kind in BLOCKS:
                    todo.append("\n")
                if kind in ("mention", "emoji") and isinstance(node.get("attrs"), dict):
                    out.append(str(node["attrs"].get("text") or ""))
                if isinstance(node.get("text"), str):
                    out.append(node["text"])
                if isinstance(node.get("content"), list):
                    todo.append(node["content"])
        return re.sub(r"\n{2,}", "\n", "".join(out)).strip() if isinstance(tree, dict | list) else said

    return document.map(plain)
