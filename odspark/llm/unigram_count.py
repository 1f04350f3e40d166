"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a text; a
Viterbi pass over the match ends carries only the best score and the number of
pieces. The rules are those of the tokenizers library's Unigram model: matches
are relaxed by start position, a better score replaces, an equal one does not
(so on a tie the piece that starts earlier stays); a character without a
one-character piece gets an unknown node 10 below the smallest score; unknown
characters count one token per UTF-8 byte (byte fallback).

Text form: a ``▁`` before the text, every space becomes ``▁``. No piece has a
``▁`` behind another character, so the lattice falls apart before each ``▁``
that follows another character: each such segment is solved once per worker
and remembered (a bounded memo). With whole-number scores the cut changes no
sum and no tie. With others the library adds floating-point scores from the
start of the text, so a choice may hang on what stands before. A remembered
segment also holds the scores of its best path and the smallest lead of any
choice in it; where the lead exceeds all possible rounding, the path's scores
are added in the whole text's order, and else the segment is solved again at
the score reached so far. Both give the whole text's own sums and ties. Matches are
taken as the automaton finds them: a few numbers a character are held, and the
matches of one end at a time, however long a text without spaces is.

Defined results: null and empty texts have 0 tokens; repeated rows are counted
row by row; an empty table gives an empty result; only the named columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odspark.llm import rolling as R

UNKNOWN_PENALTY = 10.0
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64
EPSILON = 2.0 ** -52
_SEGMENT = re.compile("▁+[^▁]*")


def load_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class Solved(NamedTuple):
    tokens: int
    score: float              # of the text up to the segment's end
    path: tuple[float, ...]   # scores of the best path's pieces (short segments only)
    gap: float                # smallest lead of a choice over the next best one
    reach: float              # bound of the sums that were compared


class UnigramCounter:
    """Counts tokens of texts; ``pieces`` are (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0):
        import ahocorasick

        self.scores = scores = {p: float(s) for p, s in pieces}
        if not all(map(math.isfinite, scores.values())):
            raise ValueError("scores must be finite numbers")
        if any("▁" in p.lstrip("▁") for p in scores) or "▁" not in scores:
            raise ValueError("▁ must be a piece and stand only at the start of pieces")
        self.whole = all(s.is_integer() for s in scores.values())
        self.unk = min(scores.values()) - UNKNOWN_PENALTY
        self.byte_fallback = all(f"<0x{b:02X}>" in scores for b in range(256))
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            if p:  # a text match of the unknown piece itself counts as unknown
                self.automaton.add_word(p, (len(p), s, p == pieces[unk_id][0]))
        self.automaton.make_automaton()
        self.memo: dict[str, int | Solved] = {}

    def _run(self, text: str) -> int:
        """Tokens of a fused run of unknown characters."""
        if text in self.scores or not self.byte_fallback:
            return 1
        return len(text.encode())

    def tokens(self, seg: str) -> int:
        """Tokens of one segment under whole-number scores."""
        # per end: best score, pieces before the open run of unknown
        # characters, start of that run (-1: none)
        best, pieces, run = [0.0], [0], [-1]
        matches, done = self.automaton.iter(seg), (len(seg), None)
        at, match = next(matches, done)
        for end in range(1, len(seg) + 1):
            top, origin, unknown, single = -math.inf, end, False, False
            while at < end:
                size, score, unk = match
                start = end - size
                s = best[start] + score
                # relaxing by start: the earlier start stays on a tie
                if s > top or s == top and start < origin:
                    top, origin, unknown = s, start, unk
                if size == 1:
                    single = True
                at, match = next(matches, done)
            if not single and best[-1] + self.unk > top:
                top, origin, unknown = best[-1] + self.unk, end - 1, True
            self._extend(seg, origin, unknown, pieces, run)
            best.append(top)
        return pieces[-1] + (self._run(seg[run[-1]:]) if run[-1] >= 0 else 0)

    def _extend(self, seg: str, origin: int, unknown: bool, pieces: list, run: list) -> None:
        """One more end, reached from ``origin`` by a piece or an unknown character."""
        open_run, n = run[origin], pieces[origin]
        if unknown:
            run.append(origin if open_run < 0 else open_run)
        else:
            run.append(-1)
            n += 1 if open_run < 0 else 1 + self._run(seg[open_run:origin])
        pieces.append(n)

    def segment(self, seg: str, base: float = 0.0) -> Solved:
        """One segment under any scores, behind a text whose best score is ``base``:
        as ``tokens``, with the path's scores and the smallest lead of a choice."""
        best, pieces, run, back = [base], [0], [-1], [(0, 0.0)]
        gap, reach = math.inf, abs(base)
        matches, done = self.automaton.iter(seg), (len(seg), None)
        at, match = next(matches, done)
        for end in range(1, len(seg) + 1):
            cands, single = [], False
            while at < end:
                size, score, unk = match
                cands.append((end - size, score, unk))
                single = single or size == 1
                at, match = next(matches, done)
            if not single:
                cands.append((end - 1, self.unk, True))
            cands.sort()
            sums = [best[start] + score for start, score, _ in cands]
            top = max(sums)
            origin, step, unknown = cands[sums.index(top)]
            reach = max(reach, -min(sums), top)
            if len(sums) > 1:
                sums.remove(top)
                gap = min(gap, top - max(sums))
            self._extend(seg, origin, unknown, pieces, run)
            best.append(top)
            back.append((origin, step))
        path, at = [], len(seg)
        while at:
            at, step = back[at]
            path.append(step)
        return Solved(pieces[-1] + (self._run(seg[run[-1]:]) if run[-1] >= 0 else 0),
                      best[-1], tuple(reversed(path)), gap, reach + reach + abs(base))

    def _known(self, seg: str):
        """The remembered solution of a segment (solved now, if there is none)."""
        found = self.memo.get(seg)
        if found is None:
            found = self.tokens(seg) if self.whole else self.segment(seg)
            if len(seg) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[seg] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = "▁" + text.replace(" ", "▁")
        if self.whole:
            return sum(map(self._known, _SEGMENT.findall(text)))
        base, total = 0.0, 0
        for m in _SEGMENT.finditer(text):
            seg = m[0]
            found = self._known(seg) if len(seg) <= MEMO_CHARS else None
            if found is None or found.gap <= 4 * (len(seg) + 1) * EPSILON * (found.reach + abs(base)):
                found = self.segment(seg, base)
                base = found.score
            else:
                for step in found.path:  # the whole text's own order of additions
                    base += step
            total += found.tokens
        return total


@R.keeps_memo
@lru_cache(maxsize=2)
def _counter(model_path: str) -> UnigramCounter:
    return UnigramCounter(load_vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, n_tokens) of every row; ``model_path`` is a file that every executor has."""
    def run(batches):
        counter = _counter(model_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t or "") for t in texts], pa.int64()),
                 pa.array([counter.count(t or "") for t in texts], pa.int64())],
                names=[key, "n_chars", "n_tokens"])

    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_chars long, n_tokens long")
