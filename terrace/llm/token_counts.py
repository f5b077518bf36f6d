"""Token counts of a unigram vocabulary, by a Viterbi search that keeps counts only.

Pieces and scores come from a SentencePiece file, which should be a unigram one. A BPE file's scores are minus merge ranks:
read as unigram scores they give counts that are no published tokenizer's (op10 has only such a file; see the README).
The text is cut before every space (a space is the mark "▁";
one is put before the text), and each part is segmented by itself: an Aho-Corasick automaton enumerates all vocabulary
matches, and dynamic programming over the part's characters carries the best score and the number of pieces.

The tie rules are those of the tokenizers library's Unigram model, against which tests compare: a path replaces another
only if its score is strictly better, and starts are tried from left to right, so of equal paths the one with the
earliest start of its last piece stays; a character that no single-character piece covers may be unknown, at ten below
the least score; unknown characters in a row are one unknown token, which counts as its UTF-8 bytes where the vocabulary
has byte pieces, else as one.

Defined cases: a null or empty text has 0 tokens; repeated rows are counted each; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.llm.common import pieces

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A worker keeps the counts of so many different parts of at most so many characters.
PARTS, LONGEST = 400_000, 64

_counters: dict = {}


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.byte_pieces, self.known = byte_pieces, {}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.longest = max(len(piece) for piece, _ in pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    @classmethod
    def from_sentencepiece(cls, path: str) -> Counter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        return cls(usable, sum(model.is_byte(i) for i in ids) == 256)

    def count_part(self, part: str) -> int:
        """The pieces of one part's best path."""
        matches = self.automaton.iter(part)
        pending = next(matches, None)
        # Of the last places as far back as a piece reaches: score, pieces, pieces before the unknown run that ends here, its bytes.
        best = deque([(0.0, 0, 0, 0)], maxlen=self.longest)
        for end, char in enumerate(part):
            ending = []
            while pending and pending[0] == end:
                ending.append(pending[1])
                pending = next(matches, None)
            ending.sort(reverse=True)  # the earliest start first
            chosen = None
            for length, score in ending:
                total = best[-length][0] + score
                if chosen is None or total > chosen[0]:
                    chosen = (total, best[-length][1] + 1, 0, 0)
            if not ending or ending[-1][0] > 1:
                total, pieces, before, size = best[-1]
                if chosen is None or total + self.unknown > chosen[0]:
                    before, size = (before if size else pieces), size + len(char.encode())
                    chosen = (total + self.unknown, before + (size if self.byte_pieces else 1), before, size)
            best.append(chosen)
        return best[-1][1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.replace(" ", MARK).split(MARK)
        # One mark stands before the text unless it begins with one.
        parts = [MARK + x for x in ([first, *rest] if first else rest)]
        if len(self.known) > PARTS:
            self.known.clear()
        known, total = self.known, 0
        for part in parts:
            n = known.get(part)
            if n is None:
                n = self.count_part(part)
                if len(part) <= LONGEST:
                    known[part] = n
            total += n
        return total


def counter(path: str) -> Counter:
    """One per Python worker and file."""
    if path not in _counters:
        _counters[path] = Counter.from_sentencepiece(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for batch in pieces(batches):
            tokens = [count(text) if text else 0 for text in batch["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(tokens, pa.int64()), batch["_chars"]], ["_id", "n_tokens", "n_chars"])

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_chars"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, n_tokens long, n_chars long").withColumnRenamed("_id", id_col)
