"""URL filter: all glob rules at once in a bit-parallel automaton over each canonical URL.

A rule is a glob (``*`` any run, ``?`` one byte) over the canonical form ``.host<0xFF>path``: host A-Z lower-cased, path as it is, no
query, no fragment. 0xFF is no byte of UTF-8, so a rule can't mistake one part for the other. The states of all
rules lie side by side in 64-bit words; a step is ``D = (D << 1 with carry) & MASK[byte] | D & LOOP`` on every URL of a batch.
Of the rules that accept, the longest wins (block on a tie). A URL that no rule takes gets the default globs' verdict.

Edge cases: very long urls are judged whole; a null url or one without ``://`` has empty host and path; an empty path starts with no ``/``; repeated rows are judged
each; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .store import mapped

END = 0xFF
# Fixed values of the query's contract: (verdict, host and path).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
# Verdict without a rule is block for hosts with a label that starts so, else allow.
DEFAULT_BLOCKED = ["adult-", "casino-", "free-bets", "porn", "xxx-"]


def host_rule(rule: str) -> bytes:
    """Glob for a host with all its subdomains and the paths that start as the rule's."""
    host, slash, path = rule.partition("/")
    return b"*." + host.encode() + bytes([END]) + (slash + path).encode() + b"*"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    cut = min(ends, default=len(rest))
    path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    host = rest[:cut]
    return (host.lower() if host.isascii() else "".join(c.lower() if c.isascii() else c for c in host)), path


class ShiftAnd:
    """Globs packed into multiword masks."""

    def __init__(self, globs: list[bytes]):
        bits = []  # (glob, symbol or None for the start, loops)
        self.final = []
        for g in globs:
            own = [[None, False]]
            for c in g:
                if c == ord("*"):
                    own[-1][1] = True
                else:
                    own.append([c, False])
            bits += own
            self.final.append(len(bits) - 1)
        self.words = -(-len(bits) // 64)
        self.mask = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros(self.words, np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        for i, (c, loops) in enumerate(bits):
            w, b = i // 64, np.uint64(1 << (i % 64))
            if c is None:
                self.begin[w] |= b
            elif c == ord("?"):
                self.mask[:, w] |= b
            else:
                self.mask[c, w] |= b
            if loops:
                self.loop[w] |= b

    def accepted(self, texts: list[bytes]) -> np.ndarray:
        """Which glob accepts which text."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        d = np.tile(self.begin, (len(texts), 1))
        flat_ = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at = np.cumsum(sizes) - sizes
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))  # texts longer than t
            own = d[:n]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            d[:n] = moved & self.mask[flat_[at[:n] + t]] | own & self.loop
        out = np.zeros((len(texts), len(self.final)), bool)
        for j, f in enumerate(self.final):
            out[order, j] = (d[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1) == 1
        return out


def _filter(rules: list[tuple[str, str]], blocked: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
        machine = ShiftAnd([host_rule(r) for _, r in ranked] + [b"*." + p.encode() + b"*" + bytes([END]) + b"*" for p in blocked])
        for b in batches:
            urls = flat.column(b, "url").to_pylist()
            for i in range(0, len(urls), 4096):
                parts = [split_url(u) for u in urls[i : i + 4096]]
                ok = machine.accepted([b"." + h.encode() + bytes([END]) + p.encode() for h, p in parts])
                n = len(ranked)
                hit = ok[:, :n].any(1)
                best = ok[:, :n].argmax(1)
                bad = ok[:, n:].any(1)
                rule = [ranked[x][1] if y else None for x, y in zip(best.tolist(), hit.tolist(), strict=True)]
                verdict = [ranked[x][0] if y else "block" if z else "allow" for x, y, z in zip(best.tolist(), hit.tolist(), bad.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [flat.column(b, "id").slice(i, len(parts)), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))], ["id", "host", "path", "rule", "verdict"]
                )

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked: list[str] = DEFAULT_BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"))
    return mapped(rows, _filter(rules, blocked), "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
