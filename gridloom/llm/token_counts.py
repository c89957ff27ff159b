"""Token counts: the library encodes batches inside Arrow functions and only lengths leave them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import CACHE_ENTRIES, vocabulary_path
from gridloom.llm.runs import slices
from gridloom.staging import staged

BATCH_BYTES = 1 << 20


def drops_white_space(tokenizer) -> bool:
    """Whether words between ASCII white space are encoded each for itself and the white space leaves no token."""
    if tokenizer.pre_tokenizer is None or any(t.content != t.content.strip() or len(t.content.split()) != 1 for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    words = ["Plain", "words", "x1.5", "(mark)", "don't", "\u00e9t\u00e9", "\u6f22\u5b57", "\u0301"]
    alone = [i for w in words for i in ids(w)]
    return all(ids(space) == [] and ids(space.join(words)) == alone for space in (" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c"))


class WordCounter:
    """Token counts of texts, summed over words between ASCII white space.

    That is a safe boundary where a vocabulary drops white space before merging: neither normalisation, lower-casing,
    pre-tokens nor special strings reach across it. Counts of words are cached, so a batch encodes each new word once.
    With any other vocabulary texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}
        self.by_word = drops_white_space(self.tokenizer)

    def count(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        words = [t.split() for t in texts]
        new = list(set().union(*words).difference(self.known))
        part, total = [], 0
        for w in [*new, None]:
            if part and (w is None or total + len(w) > BATCH_BYTES):
                found = self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
                self.known.update(zip(part, map(len, found)))
                part, total = [], 0
            if w is not None:
                part.append(w)
                total += len(w)
        return [sum(map(self.known.__getitem__, w)) for w in words]


class PieceCounter:
    """Token counts of a sentencepiece model, whose pieces cross white space: whole texts, balanced by bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[bytes]) -> list[int]:
        return [len(x) for x in self.model.encode([t.decode() for t in texts], num_threads=1)]


@lru_cache(maxsize=4)
def counter(vocabulary: str):
    path = vocabulary_path(vocabulary)
    return (PieceCounter if path.endswith(".model") else WordCounter)(path)


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts count as zero bytes and zero tokens; very long texts count whole; repeated rows stay repeated;
    other columns are not read; an empty table gives no rows. A .json vocabulary that drops white space is counted word
    by word, any other one and sentencepiece models (.model) by whole texts.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for part in slices(batches, "_text"):
            texts = [t or b"" for t in part.column("_text").cast(pa.binary()).to_pylist()]
            n = count(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return staged(docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema), "token-counts")
