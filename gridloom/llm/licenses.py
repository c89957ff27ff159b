"""License scans by fuzzy short-notice search.

A notice that may hold e errors is split into e + 1 seeds, one of which any match keeps whole. One automaton finds all
seeds; around each hit the regex library's bounded-error matching verifies the notice and gives its span and errors.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.runs import slices
from gridloom.staging import staged

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of the method: (label, words). Shorter forms stand for all longer ones that hold them.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2", "licensed under the apache license 2"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("lgpl", "gnu library general public license"),
    ("gfdl", "gnu free documentation license"),
    ("bsd", "licensed under the bsd license"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("epl", "eclipse public license version"),
    ("cddl", "common development and distribution license"),
    ("boost", "boost software license version 1"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("artistic", "licensed under the artistic license"),
    ("eupl", "european union public licence"),
    ("ofl", "sil open font license version"),
    ("cc0", "creative commons zero universal public domain dedication"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("odbl", "open data commons open database license"),
)
CHARS_PER_ERROR = 12
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class NoticeSearch:
    def __init__(self, notices: tuple[tuple[str, str], ...], chars_per_error: int):
        import ahocorasick

        self.notices = []
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (label, words) in enumerate(notices):
            errors = max(1, len(words) // chars_per_error)
            self.notices.append((label, words, errors, regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(words)}){{e<={errors}}}(?![^ ])")))
            cuts = [i * len(words) // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                at.setdefault(words[a:b], []).append((k, a))
        for seed, places in at.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, errors, notice length) in a text of single-spaced words; of overlapping spans the one with fewest errors for its length stays."""
        tried, found = set(), {}
        for end, (size, places) in self.automaton.iter(text):
            for k, a in places:
                start = end + 1 - size - a
                if (k, start) not in tried:
                    tried.add((k, start))
                    label, words, errors, pattern = self.notices[k]
                    m = pattern.search(text, max(0, start - errors - 1), start + len(words) + 2 * errors + 1)
                    if m:
                        key, wrong = (m.start(), m.end(), label), sum(m.fuzzy_counts)
                        if key not in found or wrong < found[key][0]:
                            found[key] = (wrong, len(words))
        starts: list[int] = []
        kept: dict[int, tuple[int, int, str, int, int]] = {}
        for (s, e, label), (wrong, size) in sorted(found.items(), key=lambda x: (x[1][0] / x[1][1], -x[1][1], x[0])):
            i = bisect(starts, s)
            if (not i or kept[starts[i - 1]][1] <= s) and (i == len(starts) or e <= starts[i]):
                starts.insert(i, s)
                kept[s] = (s, e, label, wrong, size)
        return [kept[s] for s in starts]


@lru_cache(maxsize=4)
def notice_search(notices: tuple[tuple[str, str], ...], chars_per_error: int) -> NoticeSearch:
    return NoticeSearch(notices, chars_per_error)


def word_numbers(norm: str, places: list[int]) -> list[int]:
    """The word that starts at each place, places in ascending order."""
    out, at, n = [], 0, 0
    for p in places:
        n += norm.count(" ", at, p)
        at = p
        out.append(n)
    return out


def base_places(norm: str, base: dict[str, str]) -> list[tuple[int, int, str]]:
    """(first word, words, label) of every place where a phrase's words stand one after another; places may overlap."""
    out, padded = [], f" {norm} "
    for phrase, label in base.items():
        places, at = [], padded.find(f" {phrase} ")
        while at >= 0:
            places.append(at)
            at = padded.find(f" {phrase} ", at + 1)
        out += [(n, phrase.count(" ") + 1, label) for n in word_numbers(norm, places)]
    return sorted(out)


def find_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_error: int = CHARS_PER_ERROR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of ASCII letters (lower-cased), digits and all non-ASCII characters. spans holds label, first_word,
    n_words and errors of base places (no errors) and fuzzy notices; score is 1 less the smallest share of errors of
    any span, 0 without spans; of equally wrong spans that overlap the longer notice stays. Null and empty texts have no
    words, empty label strings and null first_word and last_word; very long texts are searched whole; repeated rows stay
    repeated; other columns are not read; an empty table gives no rows.
    """
    notices = tuple(notices)
    span = "struct<label:string,first_word:long,n_words:long,errors:int>"
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{span}>"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = notice_search(notices, chars_per_error)
        for b in slices(batches, "_text"):
            out = []
            for raw in b.column("_text").cast(pa.binary()).to_pylist():
                words = (raw or b"").translate(WORDS).split()
                norm = b" ".join(words).decode()
                places = base_places(norm, base)
                spans = [(label, at, n, 0) for at, n, label in places]
                score = 1.0 if places else 0.0
                fuzzy = search.find(norm)
                for (s, e, label, wrong, size), first in zip(fuzzy, word_numbers(norm, [f[0] for f in fuzzy])):
                    spans.append((label, first, norm.count(" ", s, e) + 1, wrong))
                    score = max(score, 1 - wrong / size)
                starts = [p[0] for p in places]
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[2] for p in places})), ",".join(sorted({s[0] for s in spans})), score, [dict(zip(("label", "first_word", "n_words", "errors"), s)) for s in spans]))
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], [id_col, *names])

    return staged(docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema), "licenses")
