"""Secret scans: fixed patterns, and formats learned from what they find by grammar inference.

One pass over the texts lists the pattern matches and the candidate tokens.  Matched credentials are the
labelled values: their shapes (one character class per character) build a prefix tree, states whose
next-symbol frequencies are statistically compatible are merged (red-blue order, Hoeffding bound), and the
result is a probabilistic automaton per kind.  Every candidate token is scored by how much likelier its
shape is under an automaton than under the letter statistics of ordinary tokens.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citylens.llm.common import map_batches
from citylens.session import stage

# Kinds in the order that ties take.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
CUES = ("passw", "secret", "token", "api")
# Byte maps for quick tests: hex digits, and characters of candidates.
HEX_MAP = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
TOKEN_MAP = bytes(104 if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" else 32 for i in range(256))
# Training is bounded: so many distinct shapes per kind, and so many characters each.
MAX_SHAPES, MAX_SHAPE_LENGTH = 400, 128
ALPHA = 0.05
# Natural-log likelihood gain a token needs, in all and per character.
MIN_GAIN, MIN_RATE = 8.0, 0.25


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted; offsets are code points."""
    found = []
    lowered = text.lower()
    if any(cue in lowered for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"h" * MIN_HEX in text.encode("utf-8", "surrogatepass").translate(HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shape(value: str) -> str:
    """One class per character: d digit, f a-f, z g-z, F A-F, Z G-Z, others as they are."""
    return value.translate(SHAPES)


SHAPES = {**{ord(c): "d" for c in "0123456789"}, **{i: "f" if i < 103 else "z" for i in range(97, 123)}, **{i: "F" if i < 71 else "Z" for i in range(65, 91)}}


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, shape) of tokens with a digit and a letter that touch no pattern match."""
    if b"h" * 16 not in text.encode("utf-8", "surrogatepass").translate(TOKEN_MAP):
        return []
    found, at = [], 0
    spans = sorted((s, e) for s, _, e in base)
    highest = 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            highest = max(highest, spans[at][1])
            at += 1
        value = m.group()
        if highest <= m.start() and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.append((m.start(), m.end(), shape(value)))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, shapes of matched credentials and candidate tokens of every whole text."""
    def work(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch.column("doc_id"), "base": [], "labelled": [], "tokens": []}
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = pattern_spans(text)
            values = [(k, text[s:e]) for s, k, e in base]
            values = [(k, ASSIGN.match(v).group(2) if k == 0 else v) for k, v in values]
            out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            out["labelled"].append([{"kind": k, "shape": shape(v)} for k, v in values if len(v) <= MAX_SHAPE_LENGTH])
            out["tokens"].append([{"start": s, "end": e, "shape": v} for s, e, v in candidates(text, base)])
        return out

    schema = "doc_id long, base array<struct<start: int, kind: int, end: int>>, labelled array<struct<kind: int, shape: string>>, tokens array<struct<start: int, end: int, shape: string>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


class Automaton:
    """A probabilistic automaton merged from a prefix tree of counted shapes."""

    def __init__(self, shapes: Counter):
        self.next, self.visits, self.ends = [{}], [0], [0]
        counts = [Counter()]
        for text, n in sorted(shapes.items()):
            state = 0
            self.visits[0] += n
            for c in text:
                counts[state][c] += n
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.visits.append(0)
                    self.ends.append(0)
                    counts.append(Counter())
                state = self.next[state][c]
                self.visits[state] += n
            self.ends[state] += n
        self.counts = counts
        self._merge()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(math.log(2 / ALPHA) / 2) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = self.visits[a], self.visits[b]
            if self._differ(self.ends[a], na, self.ends[b], nb):
                return False
            for c in self.counts[a].keys() | self.counts[b].keys():
                if self._differ(self.counts[a][c], na, self.counts[b][c], nb):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to the states from ``a`` on."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            self.counts[a].update(self.counts[b])
            for c, target in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], target))
                else:
                    self.next[a][c] = target

    def _merge(self) -> None:
        red, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        while blue:
            state, c = blue.popleft()
            target = self.next[state][c]
            if target in red:
                continue
            for r in red:
                if self._compatible(r, target):
                    self.next[state][c] = r
                    self._fold(r, target)
                    blue.extend((r, x) for x in sorted(self.next[r]) if self.next[r][x] not in red)
                    break
            else:
                red.append(target)
                blue.extend((target, x) for x in sorted(self.next[target]))

    def table(self) -> dict:
        return {"next": self.next, "visits": self.visits, "ends": self.ends, "counts": [dict(c) for c in self.counts]}


def log_likelihood(automaton: dict, text: str) -> float:
    """Natural log of the shape's probability, its end included; unseen steps cost log(1e-4)."""
    state, total = 0, 0.0
    for c in text:
        seen = automaton["counts"][state].get(c, 0) if state is not None else 0
        total += math.log(max(seen / automaton["visits"][state], 1e-4)) if seen else math.log(1e-4)
        state = automaton["next"][state].get(c) if state is not None else None
    end = automaton["ends"][state] / automaton["visits"][state] if state is not None and automaton["visits"][state] else 0
    return total + math.log(max(end, 1e-3))


def learn_automata(scanned: DataFrame) -> dict[int, dict]:
    """One automaton per kind, from a bounded sample of the distinct labelled shapes, by hash order.

    At most MAX_SHAPES shapes per kind reach one task; their counts cover all texts.
    """
    rows = scanned.select(F.explode("labelled").alias("l")).groupBy("l.kind", "l.shape").agg(F.count(F.lit(1)).alias("n"))
    rows = stage(rows.withColumn("order", F.xxhash64("shape")), "secret-shapes")
    totals = {k: n for k, n in rows.groupBy("kind").agg(F.count(F.lit(1))).collect()}
    cut = F.coalesce(*[F.when(F.col("kind") == k, F.lit(min(1.0, MAX_SHAPES / n))) for k, n in totals.items()], F.lit(1.0))
    # Hash order: the share of the 64-bit range that holds about MAX_SHAPES of them.
    sample = rows.filter(F.pmod("order", F.lit(1_000_003)) < cut * 1_000_003)

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        import json

        made = Automaton(Counter(dict(zip(group["shape"], (int(n) for n in group["n"])))))
        return pd.DataFrame({"kind": [key[0]], "automaton": [json.dumps(made.table())]})

    import json

    return {r.kind: json.loads(r.automaton) for r in sample.groupBy("kind").applyInPandas(build, "kind int, automaton string").collect()}


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and more: spans (start, kind number, end) from the patterns and from the automata.

    Offsets are code points, ends exclusive.  Null text is empty; repeated rows are scanned each; an empty
    table gives no rows; other columns are ignored.
    """
    scanned = stage(scan(docs), "secret-spans")
    known = learn_automata(scanned)
    letters = scanned.select(F.explode("tokens").alias("t")).select(F.explode(F.split("t.shape", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    # At most one row per ASCII class.
    plain = Counter({c: n for c, n in letters.collect()})
    total = sum(plain.values())

    def score(text: str) -> bool:
        back = sum(math.log((plain.get(c, 0) + 1) / (total + 64)) for c in text)
        gain = max((log_likelihood(a, text) for a in known.values()), default=-math.inf) - back
        return gain >= MIN_GAIN and gain >= MIN_RATE * len(text)

    def work(batch: pa.RecordBatch) -> dict:
        tokens = batch.column("tokens").to_pylist()
        more = [[{"start": t["start"], "kind": 3, "end": t["end"]} for t in row if score(t["shape"])] for row in tokens]
        return {"doc_id": batch.column("doc_id"), "base": batch.column("base"), "more": more}

    span = "array<struct<start: int, kind: int, end: int>>"
    return map_batches(scanned.select("doc_id", "base", "tokens"), work, f"doc_id long, base {span}, more {span}")
