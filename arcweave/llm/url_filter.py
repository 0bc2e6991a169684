"""URL rules by a bit-parallel wildcard automaton (operator 3).

Every rule becomes glob patterns over the canonical url (host, separator, path); all patterns lie side by side in the bits of a few
64-bit words, and one Shift-And step for each byte of the url moves all of them at once. A batch of urls is stepped together, so the
work of a byte is a handful of vector operations whatever the number of rules. A star is a bit that may stay where it is.

A url without "://", or a null one, has empty host and path; no rule fits it and its verdict is the default patterns'. Equal rows
stay equal rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

#: A byte that UTF-8 never has parts host and path, so that no star of a host pattern matches into the path unseen.
SEPARATOR = 0xFF
ANY, STAR = -1, -2


@dataclass(frozen=True)
class Rule:
    """Fits host and all its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def patterns(self) -> list[list[int]]:
        body = [*self.host.encode(), SEPARATOR, *self.path.encode(), STAR]
        return [body, [STAR, ord("."), *body]]


#: The rules that the query is given.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
#: Globs over host/path that block where no rule fits: hosts of spam, gambling, pill, advert and adult sites.
BLOCKED = ("*casino-*/*", "*free-bets.*/*", "*cheap-pills.*/*", "*ads-track.*/*", "*spam-farm.*/*", "*adult-*/*")


def glob_pattern(glob: str) -> list[int]:
    """A glob with * and ? over host/path; its first slash parts the two."""
    host, _, path = glob.partition("/")
    read = lambda s: [STAR if c == ord("*") else ANY if c == ord("?") else c for c in s.encode()]
    return [*read(host), SEPARATOR, *read(path)]


class Automaton:
    def __init__(self, patterns: list[list[int]]):
        bits = sum(sum(t != STAR for t in p) + 1 for p in patterns)
        self.words = max(1, -(-bits // 64))
        accept, stay, start = np.zeros((256, bits), bool), np.zeros(bits, bool), np.zeros(bits, bool)
        self.ends, at = [], 0
        for p in patterns:
            start[at] = True
            for t in p:
                if t == STAR:
                    stay[at] = True
                else:
                    accept[slice(None) if t == ANY else t, at] = True
                    at += 1
            self.ends.append(at)
            at += 1
        pack = lambda x: np.packbits(np.pad(x, [*[(0, 0)] * (x.ndim - 1), (0, self.words * 64 - bits)]), axis=-1, bitorder="little").view("<u8")
        self.accept, self.stay, self.start = pack(accept), pack(stay), pack(start)

    def match(self, urls: list[bytes]) -> np.ndarray:
        """matrix[i, k]: pattern k matches the whole of urls[i]."""
        sizes = np.fromiter(map(len, urls), np.int64, len(urls))
        order = np.argsort(-sizes, kind="stable")
        sorted_sizes, flat = sizes[order], np.frombuffer(b"".join(urls) + b"\0", np.uint8)
        begin = (np.cumsum(sizes) - sizes)[order]
        state = np.tile(self.start, (len(urls), 1))
        for j in range(int(sizes.max(initial=0))):
            live = int(np.searchsorted(-sorted_sizes, -j, side="left"))  # urls longer than j
            now = state[:live]
            moved = now & self.accept[flat[begin[:live] + j]]
            carry = moved >> np.uint64(63)
            next_state = (moved << np.uint64(1)) | (now & self.stay)
            next_state[:, 1:] |= carry[:, :-1]
            state[:live] = next_state
        bits = np.unpackbits(state.view(np.uint8), axis=1, bitorder="little")[:, self.ends].astype(bool)
        out = np.empty_like(bits)
        out[order] = bits
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    shape, text = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, shape, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, shape, 2)


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, by its name; null if none) and verdict of each (page_id, url)."""
    owner = [i for i, r in enumerate(rules) for _ in r.patterns()]
    patterns = [p for r in rules for p in r.patterns()] + [glob_pattern(g) for g in blocked]
    rank = sorted(range(len(rules)), key=lambda i: (len(rules[i].name), -i))  # a later one in this order wins

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        place = np.array([rank.index(i) for i in owner] + [-1])[: len(owner)]
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            hit = automaton.match([h.encode() + bytes([SEPARATOR]) + p.encode() if h or p else b"" for h, p in zip(hosts, paths, strict=True)])
            best = np.where(hit[:, : len(owner)], place, -1).max(axis=1, initial=-1)
            bad = hit[:, len(owner) :].any(axis=1)
            rule = [rules[rank[b]].name if b >= 0 else None for b in best]
            verdict = [rules[rank[b]].verdict if b >= 0 else "block" if x else "allow" for b, x in zip(best, bad, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return filter_urls(read_table(spark, sf_dir, "pages"))


def _fits(rule: Rule) -> str:
    return f"((host = '{rule.host}' OR host LIKE '%.{rule.host}') AND starts_with(path, '{rule.path}'))"


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r.name))
OP3_SQL = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages),
r AS (SELECT *, CASE {' '.join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)}
  WHEN {' OR '.join("host LIKE '" + g.partition('/')[0].replace('*', '%') + "'" for g in BLOCKED)} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
