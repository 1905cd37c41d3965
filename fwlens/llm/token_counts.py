"""Token counts of a unigram tokenizer without building tokens: Aho-Corasick matches and a count-only Viterbi.

The vocabulary (pieces and scores) is read from a public piece file. Text is prepared as that kind of tokenizer does: one
blank mark in front, blanks replaced by the mark. For each end position the automaton gives all pieces that end there; the
best score so far and its number of pieces are all that is kept.

Tie rules of the tokenizer, kept exactly: of equal scores the piece that starts earliest wins (a later start replaces it
only with a higher score); a character without a one-character piece may also be an unknown of the lowest score less ten;
unknown characters become one byte piece per byte. Sums are formed from left to right in double precision.

Chunks between characters that no piece holds inside are independent, since every path passes their borders; chunks are
counted once per task and remembered, within a bound.

Scores of the shipped file are whole numbers, for which sums of chunks equal sums over the text exactly; for a file with
other scores the text is not cut into chunks.

Cases: a null or empty text has no tokens; repeated rows get equal counts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
#: Fixed value: what an unknown character costs beyond the lowest score.
UNKNOWN_PENALTY = 10.0
MEMO_CHUNKS = 300_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces with their scores, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts pieces of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.whole_scores = all(float(score).is_integer() for _, score in vocabulary)
        # a blank mark that follows something else starts a new piece, unless a piece holds it inside
        pieces = [piece for piece, _ in vocabulary]
        self.cuts_at_marks = self.whole_scores and not any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)
        # control characters that only one-character pieces hold are one token each, known or not
        self.alone = frozenset(c for c in "\n\t\r" if not any(c in piece for piece in pieces if len(piece) > 1))
        self.singles = frozenset(piece for piece in pieces if len(piece) == 1)
        self.memo: dict[str, int] = {}

    def _best(self, text: str) -> int:
        """Pieces of the best path; byte pieces of unknown characters are counted one by one.

        The automaton names ends from left to right and, for one end, the longest piece first.
        """
        size = len(text)
        score, pieces = [0.0] * (size + 1), [0] * (size + 1)
        if self.singles.issuperset(text):
            for end, (length, value) in self.automaton.iter(text):
                start = end + 1 - length
                total = value + score[start]
                end += 1
                if not pieces[end] or total > score[end]:
                    score[end], pieces[end] = total, pieces[start] + 1
            return pieces[size]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for end, matches in enumerate(ends):
            best, count = None, 0
            for length, value in matches:
                start = end + 1 - length
                total = value + score[start]
                if best is None or total > best:
                    best, count = total, pieces[start] + 1
            if text[end] not in self.singles:
                total = self.unknown + score[end]
                if best is None or total > best:
                    best, count = total, pieces[end] + len(text[end].encode("utf-8", "surrogatepass"))
            score[end + 1], pieces[end + 1] = best, count
        return pieces[size]

    def _chunks(self, text: str):
        """Chunks that every segmentation keeps apart."""
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.cuts_at_marks:
            return self._best(text)
        total, memo = 0, self.memo
        parts = re.split(f"([{''.join(self.alone)}])", text) if self.alone else [text]
        for part in parts:
            if part in self.alone:
                total += 1
                continue
            for chunk in self._chunks(part):
                n = memo.get(chunk)
                if n is None:
                    if len(memo) >= MEMO_CHUNKS:
                        memo.clear()
                    n = self._best(chunk)
                    if len(chunk) <= 64:
                        memo[chunk] = n
                total += n
        return total


def _counted(path: str):
    def run(batches):
        counter = UnigramCounter(read_vocabulary(path))
        for batch in batches:
            counts = np.fromiter((counter.count(text) for text in batch["text"]), dtype=np.int64, count=len(batch))
            sizes = [len(text.encode("utf-8", "surrogatepass")) if text else 0 for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": counts, "n_bytes": sizes})

    return run


def count_tokens(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes; the path must be readable on every machine."""
    return documents.select("doc_id", "text").mapInPandas(_counted(vocabulary_path), "doc_id bigint, n_tokens bigint, n_bytes bigint")
