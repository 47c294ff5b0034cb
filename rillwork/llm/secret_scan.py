"""Secret scans with one combined deterministic automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, tidy
from .automata import Automaton, compile_patterns

#: Bytes of a lane, before it is stretched to the next byte that no match can cover.
LANE = 384
#: So few lanes don't repay a step together.
FEW = 16
#: Bytes of text scanned at a time.
SLICE = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A secret is ``lead`` and then ``body``, of which ``least`` bytes at least; shorter ones use up their text."""

    kind: str
    body: str
    lead: str = ""
    ignore_lead_case: bool = False
    least: int = 1


#: Kinds in the order in which equal starts are listed; the first three are the base.
RULES = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", least=15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
BASE = 3


class Scanner:
    """The rules as one automaton for the pass over all bytes, and two each, backwards and forwards, for the spans of what it hits."""

    def __init__(self, rules: Sequence[Rule]):
        def cased(rule: Rule) -> str:
            # only the lead ignores case, so its letters are written as pairs
            return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() and rule.ignore_lead_case and rule.lead[i - 2 : i] != "\\x" and rule.lead[i - 1 : i] != "\\" else c for i, c in enumerate(rule.lead))

        self.rules = tuple(rules)
        self.whole = [compile_patterns([(cased(r) + r.body, False)], anchored=True) for r in rules]
        self.lead = [compile_patterns([(cased(r), False)], anchored=True) if r.lead else None for r in rules]
        self.all: Automaton = compile_patterns([(cased(r) + r.body, False) for r in rules], anchored=False)
        self.resets = self.all.resets()
        self.back = [compile_patterns([(cased(r) + r.body, False)], anchored=False, backwards=True) for r in rules]

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """Lanes ``(start, end, rules)`` with a match of those rules' patterns; ``bounds`` part the texts in ``data``.

        A lane ends after a byte that resets the automaton, or with its text, so all start in state 0 and no match
        lies in two. All lanes step together, longest first; a step reads one byte of each. The ``FEW`` longest end by themselves.
        """
        resets = np.flatnonzero(self.resets[data]) + 1
        goals = np.concatenate([np.arange(a + LANE, b, LANE) for a, b in zip(bounds[:-1], bounds[1:]) if b - a > LANE] or [np.empty(0, np.int64)])
        at = np.searchsorted(resets, goals)
        cuts = np.unique(np.concatenate([bounds, resets[at[at < len(resets)]]]))
        begin, length = cuts[:-1], np.diff(cuts)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        if not len(length):
            return []
        shorter = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than each step
        state, seen = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int64)
        step, accepts = self.all.step, self.all.accepts
        for t in range(length[0]):
            k = shorter[t]
            if k <= FEW:
                for i in range(k):
                    seen[i] |= self.all.seen(data[begin[i] + t : begin[i] + length[i]].tobytes(), int(state[i]))
                break
            now = step[(state[:k] << 8) + data[begin[:k] + t]]
            state[:k] = now
            seen[:k] |= accepts[now]
        return sorted((int(begin[i]), int(begin[i] + length[i]), int(seen[i])) for i in np.flatnonzero(seen))

    def spans(self, data: bytes, start: int, end: int, which: int) -> Iterator[tuple[int, int, int]]:
        """``(from, rule, to)`` of each rule in ``which``: leftmost, longest, without overlap within a rule.

        A pass from the end finds where matches begin, so that no byte is tried as a start in vain: time grows with the lane's length.
        """
        for r, rule in enumerate(self.rules):
            if not which >> r & 1:
                continue
            done = start
            for i in self.back[r].begins(data, start, end):
                if i < done:
                    continue
                done = self.whole[r].longest(data, i, end)
                body = self.lead[r].longest(data, i, done) if self.lead[r] else i
                if done - body >= rule.least:
                    yield i, r, done


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Built once for each Python worker."""
    return Scanner(rules)


def find_secrets(texts: pa.Array, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text (null: empty), its spans ``(start, rule, end)`` in code points, by start, then rule."""
    scan = scanner(rules)
    texts = texts.cast(pa.large_string())
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    if not len(texts):
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, side="right")) - 1)
        last = min(last, len(texts))
        low, high = int(offsets[first]), int(offsets[last])
        part = data[low:high]
        bounds = np.unique(offsets[first : last + 1] - low)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, which in scan.hits(part, bounds):
            row = int(np.searchsorted(offsets, low + start, side="right")) - 1
            found.setdefault(row, []).extend((low + start + a, r, low + start + b) for a, r, b in scan.spans(part[start:end].tobytes(), 0, end - start, which))
        for row, spans in found.items():
            base = int(offsets[row])
            points = np.cumsum((data[base : int(offsets[row + 1])] & 0xC0) != 0x80)  # code points up to each byte
            place = lambda at: int(points[at - base - 1]) if at > base else 0
            out[row] = sorted((place(a), r, place(b)) for a, r, b in spans)
        first = last
    return out


def scan_column(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``, an array of ``(kind, start, end)`` for every row.

    Nulls and empty texts have no spans; texts are read whole, in slices of ``SLICE`` bytes or one text, so memory
    is bounded by the longest text. Rows are independent: repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    rules = tuple(rules)
    key_type = docs.schema[key].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": rules[r].kind, "start": a, "end": b} for a, r, b in row] for row in find_secrets(batch.column(1), rules)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], [key, "spans"])

    return docs.select(key, F.col(text)).mapInArrow(tidy(scan), f"`{key}` {key_type.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_secrets`` for every document."""
    base = [r.kind for r in RULES[:BASE]]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = scan_column(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_secrets"),
    )
