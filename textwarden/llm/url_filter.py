"""URL filters over a sorted, memory-mapped array of digests."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import handed_back, new_folder, numbered, write_file

#: The rules of the registered query: host and path, and what they decide.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: What becomes of a URL that no rule fits.
DEFAULT = "allow"
#: The largest index that is sent to executors, in bytes; about 20 million rules.
MAX_INDEX = 1 << 30
MAGIC = b"URLDIG01"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")
    )


def path_of(url: Column) -> Column:
    """From the end of the host to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def build_index(rules: Iterable[tuple[str, str]], hashed: Callable[[str], int] = digest) -> bytes:
    """Keys in ascending order, then offsets, verdicts and the full rules.

    The first array holds the rules' digests; the second one those of their hosts, which
    are probed first, so that a host without rules costs one search for each of its
    domains. A rule that is given twice counts once, as it stands last.
    """
    chosen = dict(rules)
    for rule, verdict in chosen.items():
        if "/" not in rule or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {rule!r} {verdict!r}")
    ordered = sorted((hashed(rule), rule.encode(), verdict == "block") for rule, verdict in chosen.items())
    hosts = sorted({hashed(rule.partition("/")[0]) for rule in chosen})
    lengths = sorted({len(rule.partition("/")[2]) + 1 for rule in chosen})
    ends = np.cumsum([0, *(len(x[1]) for x in ordered)], dtype=np.uint64)
    head = np.array([len(ordered), len(hosts), len(lengths)], dtype=np.uint64)
    parts = [
        MAGIC,
        head.tobytes(),
        np.array([x[0] for x in ordered], dtype=np.uint64).tobytes(),
        np.array(hosts, dtype=np.uint64).tobytes(),
        np.array(lengths, dtype=np.uint64).tobytes(),
        ends.tobytes(),
        bytes(x[2] for x in ordered),
        *(x[1] for x in ordered),
    ]
    return b"".join(parts)


class DigestArray:
    """A memory-mapped index; probing is a binary search over whole arrays."""

    def __init__(self, path: str, hashed: Callable[[str], int] = digest):
        self.hashed = hashed
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(raw[:8]) != MAGIC:
            raise ValueError(f"not an index of URL rules: {path}")
        n, hosts, lengths = (int(x) for x in raw[8:32].view(np.uint64))
        at = 32
        self.keys, at = raw[at : at + 8 * n].view(np.uint64), at + 8 * n
        self.hosts, at = raw[at : at + 8 * hosts].view(np.uint64), at + 8 * hosts
        self.lengths, at = [int(x) for x in raw[at : at + 8 * lengths].view(np.uint64)], at + 8 * lengths
        self.ends, at = raw[at : at + 8 * (n + 1)].view(np.uint64), at + 8 * (n + 1)
        self.block, self.text = raw[at : at + n], raw[at + n :]

    def rule(self, i: int) -> str:
        return bytes(self.text[int(self.ends[i]) : int(self.ends[i + 1])]).decode()

    def find(self, candidates: list[str]) -> np.ndarray:
        """The place of each candidate, or -1; equal digests of other strings are passed over."""
        wanted = np.fromiter(map(self.hashed, candidates), dtype=np.uint64, count=len(candidates))
        first = np.searchsorted(self.keys, wanted)
        found = np.full(len(candidates), -1, dtype=np.int64)
        open_ = np.flatnonzero(first < len(self.keys))
        for i in open_[self.keys[first[open_]] == wanted[open_]]:
            k = int(first[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:
                if self.rule(k) == candidates[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def domains(self, hosts: Iterable[str]) -> dict[str, list[str]]:
        """Of each host and its parent domains, those that may have rules."""
        own = {h: [".".join(h.split(".")[i:]) for i in range(h.count(".") + 1)] for h in hosts}
        all_ = list(dict.fromkeys(itertools.chain.from_iterable(own.values())))
        keys = np.fromiter(map(self.hashed, all_), dtype=np.uint64, count=len(all_))
        place = np.minimum(np.searchsorted(self.hosts, keys), max(0, len(self.hosts) - 1))
        there = set(itertools.compress(all_, self.hosts[place] == keys)) if len(self.hosts) else set()
        return {h: [d for d in ds if d in there] for h, ds in own.items()}

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """The longest fitting rule of each URL and its verdict; of equally long ones that with the longer host."""
        domains = self.domains(set(hosts))
        rows: list[int] = []
        tried: list[str] = []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            for domain in domains[host]:
                for n in self.lengths:
                    if n > len(path):
                        break
                    rows.append(row)
                    tried.append(domain + path[:n])
        best: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        for row, rule, place in zip(rows, tried, self.find(tried)):
            if place >= 0 and (best[row][0] is None or len(rule) > len(best[row][0])):
                best[row] = (rule, "block" if self.block[place] else "allow")
        return best


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str]], *, url: str = "url", default: str = DEFAULT
) -> DataFrame:
    """The rows with host, path, rule (null where none fits) and verdict (else `default`).

    A rule is a host and the start of a path; it fits its host and all subdomains. The
    longest rule that fits decides. Null URLs and URLs without :// have an empty host and
    path, which no rule fits. The index is written to the shared folder, sent to every
    executor once and mapped into memory there, so workers of a machine share its pages;
    an index above MAX_INDEX is refused. URLs are judged where they are: no shuffle.
    Input columns of the names of the four added ones are replaced by these; others are kept.
    Rows that repeat are judged alike, an empty table gives none.
    """
    spark = pages.sparkSession
    index = build_index(rules)
    if len(index) > MAX_INDEX:
        raise ValueError(f"the index takes {len(index)} bytes; {MAX_INDEX} may be sent to executors")
    path = f"{new_folder(spark, 'url-rules')}.digests"
    write_file(path, [index])
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[1]

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        array = DigestArray(SparkFiles.get(name))
        for hosts, paths in batches:
            yield pd.DataFrame(array.judge(hosts.tolist(), paths.tolist()), columns=["rule", "verdict"])

    rows, names = numbered(pages)
    out = rows.withColumns({"host": host_of(F.col(names[url])), "path": path_of(F.col(names[url]))})
    out = out.withColumn("judged", judged("host", "path"))
    verdict = F.coalesce("judged.verdict", F.lit(default))
    return handed_back(out.withColumns({"rule": F.col("judged.rule"), "verdict": verdict}), names, ("host", "path", "rule", "verdict"))


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, RULES).drop("url")


SQL = f"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
rules AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p
  FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}) x(rule, verdict)
),
fits AS (
  SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT p.page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON p.page_id = f.page_id
"""
