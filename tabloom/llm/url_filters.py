"""URL filters: a trie over reversed host labels and path segments, broadcast to the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import boxed

#: (verdict, host, path) of the query; fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Rules whose texts are longer than this together go to several tries, one after the other, each broadcast on its own.
TRIE_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (ASCII letters in lower case) and path; both empty without a `://`."""
    if not url or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(FOLD), path


class Trie:
    """Nodes are dicts. Host labels come reversed, then the whole path segments; what is left of a rule's path, the
    beginning of a segment, hangs at the last node as a list."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(FOLD).split(".")):
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            node.setdefault("ends", []).append((len(host) + len(path), verdict == "block", rest, host + path, verdict))

    def best(self, host: str, path: str) -> tuple | None:
        """The longest fitting rule; of two equally long ones a block. Walks one host chain, and from each of its nodes the path."""
        if not host:
            return None
        segments, node, found = path.split("/"), self.root, None
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            below = node
            for i, segment in enumerate(segments):
                for end in below.get("ends", ()):
                    if segment.startswith(end[2]) and (found is None or end[:2] > found[:2]):
                        found = end
                below = below.get(("p", segment)) if i + 1 < len(segments) else None
                if below is None:
                    break
        return found


def blocks(rules: list[tuple[str, str, str]], most: int) -> Iterator[list]:
    block, held = [], 0
    for rule in rules:
        cost = sum(map(len, rule)) + 1
        if block and held + cost > most:
            yield block
            block, held = [], 0
        block.append(rule)
        held += cost
    yield block


def _fit(trie: Broadcast) -> Callable:
    @F.pandas_udf("host string, path string, rule string, verdict string, rank long")
    def fit(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = split_url(u)
            end = trie.value.best(host, path)
            rows.append((host, path, *((end[3], end[4], 2 * end[0] + end[1]) if end else (None, None, -1))))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "rank"])

    return fit


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", most: int = TRIE_BYTES) -> DataFrame:
    """pages with host, path, rule and verdict, in one pass without a shuffle.

    A rule fits its host, all subdomains and every path that begins with its own; the longest wins, a block over an
    allow of equal length. Without a fitting rule, rule is null and verdict is `default`. A null url, or one without
    `://`, has an empty host and path and fits nothing. Rows stay as they are, repeated ones too; columns of pages named
    like the four new ones are replaced. The rules live on the driver; past `most` characters they go out in blocks.
    """
    spark = pages.sparkSession
    best = None
    for block in blocks(list(rules), most):
        fitted = _fit(spark.sparkContext.broadcast(Trie(block)))(F.col(f"`{url}`"))
        best = fitted if best is None else F.when(fitted["rank"] > best["rank"], fitted).otherwise(best)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return boxed(pages, fit=best).select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], "fit.host", "fit.path", "fit.rule", F.coalesce("fit.verdict", F.lit(default)).alias("verdict")
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).drop("url")


ORACLE = f"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM cut)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""
