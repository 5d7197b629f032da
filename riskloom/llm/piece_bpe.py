"""SentencePiece merge-type encoding by a prefix table, and decoding.

For every prefix of a word the table holds the one last token that the merge encoding of
that prefix ends in. An automaton over the vocabulary finds the tokens that end at a
position; the one that is compatible with the last token of the prefix before it is the
last token here. Two tokens are compatible if merging their joined text gives just the two.
The ids are then recovered from the end of the word backwards.

A text is first cut where no token of the vocabulary can reach across: before a run of
spaces and around line breaks. This is checked when the model is loaded. Long words need
no special path, as the table is linear in their length. Runs of spaces, whose tokens have
equal scores, are merged by the plain procedure, once for each length.

Defined results: a null or empty text has the end id only and decodes to the empty text;
characters outside the vocabulary become byte tokens; repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_texts, per_worker

SPACE = "▁"
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
UNKNOWN = -1


class PieceBpe:
    """Encoder and decoder of one model file. `kept` bounds the words remembered."""

    def __init__(self, model_file: str, kept: int = 600_000) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("made for merge-type models with byte fallback, a leading space and no other normalisation")
        self.pieces = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end_id = sentencepiece.SentencePieceProcessor(model_file=model_file).eos_id()
        words = [p for p in self.ids if p.strip(SPACE)]
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) or "\n" in p for p in words) or USER_DEFINED in self.types:
            raise ValueError("a piece reaches across a place where texts are cut")
        lowest = min(self.score[p] for p in words)
        if len({self.score[p] for p in words}) != len(words) or any(self.score[p] >= lowest for p in self.ids if not p.strip(SPACE) and len(p) > 1):
            raise ValueError("scores do not give one order of merges")
        self._tables(words)
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.kept, self.young, self.old = kept, {}, {}

    def _tables(self, words: list[str]) -> None:
        """The automaton of all tokens that merging can make, their order of making, and
        the two tokens that each is made of (itself, if it is one character)."""
        self.automaton = ahocorasick.Automaton()
        self.order, self.halves, chars = {}, {}, set("".join(words)) | {SPACE}
        for rank, p in enumerate(sorted(words, key=lambda p: (len(p) > 1, -self.score[p])) + [SPACE]):
            steps: list[tuple[str, str]] = []
            if p in self.ids and self.merge(p, steps) == [p]:
                token = self.ids[p]
                self.order[token] = rank if p != SPACE else -1
                self.halves[token] = tuple(self.ids[x] for x in steps[-1]) if steps else (token, token)
                self.automaton.add_word(p, (len(p), token))
        if any(c not in self.ids for c in chars):
            raise ValueError("a character of a piece is no piece itself")
        self.automaton.make_automaton()
        self.joined = {h: t for t, h in self.halves.items() if h != (t, t)}

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """The plain procedure: best-scored neighbours first, leftmost among equals. `steps`
        gets the pairs that were merged."""
        part = list(text)
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(part) and (joined := part[left] + part[right]) in self.score:
                heapq.heappush(heap, (-self.score[joined], left, right, joined))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, joined = heapq.heappop(heap)
            if not part[left] or not part[right] or after[left] != right or part[left] + part[right] != joined:
                continue
            if steps is not None:
                steps.append((part[left], part[right]))
            part[left], part[right] = joined, ""
            after[left] = after[right]
            if after[right] < len(part):
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in part if p]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens gives just these two."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= 2 * self.kept:
                self.pairs.clear()
            found = self.pairs[key] = self._never_joined(left, right)
        return found

    def _never_joined(self, left: int, right: int) -> bool:
        """Unmakes the two tokens, the one made later first, and looks at the two that stand
        at the boundary at each time: had they a common token that is made before the one
        just unmade (on the left: not after it), merging would have crossed the boundary."""
        order, halves, score, pieces = self.order, self.halves, self.order, self.pieces
        limit, open_end = float("inf"), False  # what is made before `limit` happened first
        while True:
            crossing = self.ids.get(pieces[left] + pieces[right])
            if crossing in score and (order[crossing] < limit or open_end and order[crossing] == limit):
                return False
            can_left, can_right = halves[left][1] != left, halves[right][0] != right
            if not can_left and not can_right:
                return True
            if can_left and (not can_right or order[left] > order[right]):
                limit, open_end, left = order[left], False, halves[left][1]
            else:
                limit, open_end, right = order[right], True, halves[right][0]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text without cuts, by its prefix table."""
        last, size = [UNKNOWN] * (len(word) + 1), [1] * (len(word) + 1)
        done = 0
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if end == done:
                continue
            start = end - length
            if start == 0 or last[start] == UNKNOWN or self.compatible(last[start], token):
                last[end], size[end], done = token, length, end
        out: list[int] = []
        at = len(word)
        while at:
            if last[at] == UNKNOWN:
                out += [self.bytes[b] for b in reversed(word[at - 1].encode("utf-8", "replace"))]
            else:
                out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def run_ids(self, n: int) -> list[int]:
        if n not in self.runs:
            if len(self.runs) >= 10_000:
                self.runs.clear()
            self.runs[n] = [self.ids[p] for p in self.merge(SPACE * n)]
        return self.runs[n]

    def cut_ids(self, cut: str) -> list[int]:
        spaces = len(cut) - len(cut.lstrip(SPACE))
        if spaces < 2:
            return self.word_ids(cut)
        if spaces == len(cut):
            return self.run_ids(spaces)
        ids = self.word_ids(cut[spaces - 1 :])
        if ids[0] == self.ids[SPACE]:  # the last space joins no token of the word
            return self.run_ids(spaces) + ids[1:]
        return self.run_ids(spaces - 1) + ids

    def cuts(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def known(self, cut: str) -> tuple[int, str, str]:
        """Number of ids, the ids as text, and what they decode to, for one cut."""
        found = self.young.get(cut) or self.old.get(cut)
        if found is None:
            ids = self.cut_ids(cut)
            found = (len(ids), " ".join(map(str, ids)), self.surface(ids))
        if len(cut) <= 64:
            if len(self.young) >= self.kept // 2:
                self.old, self.young = self.young, {}
            self.young[cut] = found
        return found

    def encode(self, text: str) -> list[int]:
        """All ids of a text with the end id."""
        return [i for c in self.cuts(text) for i in self.cut_ids(c)] + [self.end_id]

    def surface(self, ids: list[int]) -> str:
        out, pending = [], bytearray()
        for i in ids:
            if self.types[i] == BYTE:
                pending.append(int(self.pieces[i][1:-1], 16))
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.types[i] == NORMAL:
                out.append(self.pieces[i])
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the leading space that encoding adds."""
        return self.surface(ids).removeprefix(" ")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the decoded text."""
        get = self.young.get
        parts = [get(c) or self.known(c) for c in self.cuts(text)]
        ids = " ".join([p[1] for p in parts] + [str(self.end_id)])
        decoded = "".join([p[2] for p in parts]).removeprefix(" ")
        sha = hashlib.sha256
        return sum(p[0] for p in parts) + 1, sha(ids.encode()).hexdigest(), sha(decoded.encode("utf-8", "replace")).hexdigest()


def _model(model_file: str) -> PieceBpe:
    return per_worker(f"pieces {model_file}", lambda: PieceBpe(model_file))


def piece_ids(text: Column, model_file: str) -> Column:
    """Array of all ids of a text with the end id."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(model_file)
        for batch in batches:
            yield pd.Series([model.encode(t) for t in as_texts(batch)])

    return run(text)


def piece_text(ids: Column, model_file: str) -> Column:
    """Text of an array of ids; a null array is the empty text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(model_file)
        for batch in batches:
            yield pd.Series([model.decode([] if x is None else list(x)) for x in batch], dtype=object)

    return run(ids)


def piece_digests(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(model_file)
        for batch in batches:
            yield pd.DataFrame([model.digests(t) for t in as_texts(batch)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("x")).select("doc_id", "x.*")
