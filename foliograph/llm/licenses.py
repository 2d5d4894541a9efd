"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags in a text's word
sequence; the expression behind a tag is read by a shunting-yard parser and evaluated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliograph.llm.common import WORD_TABLE, row_of_batch, table, text_blocks, word_places
from foliograph.llm.decontam import LOWER_AZ, UPPER_AZ, WORD

#: Phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices: label and how far the words alone speak for it.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.8), "gnu library general public license": ("lgpl", 0.8), "gnu affero general public license": ("agpl", 0.8),
    "gnu free documentation license": ("gfdl", 0.8), "mozilla public license": ("mpl", 0.8), "eclipse public license": ("epl", 0.8), "boost software license": ("bsl", 0.8),
    "isc license": ("isc", 0.7), "bsd license": ("bsd", 0.7), "bsd 2 clause": ("bsd", 0.8), "bsd 3 clause": ("bsd", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.7), "licensed under the mit": ("mit", 0.7), "apache 2 0": ("apache", 0.5), "cc by sa": ("cc-by-sa", 0.8), "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8), "cc by nc sa": ("cc-by-nc-sa", 0.8), "cc by nc nd": ("cc-by-nc-nd", 0.8), "cc0": ("cc0", 0.5), "creative commons attribution": ("cc-by", 0.7), "unlicense": ("unlicense", 0.5),
    "public domain": ("public-domain", 0.3), "all rights reserved": ("all-rights-reserved", 0.5),
}
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.95
TAG = "spdx license identifier"
#: What stands between a tag's last word and the end of its line is an expression, if it begins so.
TAGGED = re.compile(rb":[ \t]*([^\r\n]*)")
#: Identifier prefixes, longest kin first, and the family label; whether the family is permissive.
FAMILIES = (("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("apache", "apache", True), ("mit", "mit", True), ("bsd", "bsd", True), ("mpl", "mpl", False), ("epl", "epl", False), ("isc", "isc", True), ("bsl", "bsl", True), ("gfdl", "gfdl", False), ("unlicense", "unlicense", True), ("zlib", "zlib", True), ("cc0", "cc0", True))
BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[frozenset[str], bool]:
    name = identifier.lower().rstrip("+")
    for prefix, label, permissive in FAMILIES:
        if name.startswith(prefix):
            return frozenset([label]), permissive
    if m := re.match(r"cc-by((?:-nc|-nd|-sa)*)", name):
        return frozenset(["cc-by" + m[1]]), not m[1]
    return frozenset([name]), False


def evaluate(expression: str) -> tuple[frozenset[str], bool] | None:
    """Labels and permissiveness of the expression at the beginning; None if there is none.

    `with` binds closest and keeps its licence's value, its exception counts as no licence; `and` needs both to be
    permissive; `or` either. Equal operators group from the left. What is left open at the end is closed there: operators
    without an operand behind them don't count, and parentheses end where the expression does.
    """
    ops, values, operand, whole = [], [], True, 0

    def apply():
        op, b, a = ops.pop(), values.pop(), values.pop()
        values.append((a[0], a[1]) if op == "with" else (a[0] | b[0], a[1] and b[1] if op == "and" else a[1] or b[1]))

    for match in re.finditer(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*|\S", expression):
        token, word = match[0], match[0].lower()
        if operand and token == "(":
            ops.append(token)
        elif operand and re.match(r"[A-Za-z0-9]", token) and word not in BINDS:
            values.append(family(token))
            operand = False
        elif not operand and word in BINDS:
            while ops and ops[-1] != "(" and BINDS[ops[-1]] >= BINDS[word]:
                apply()
            whole = len(ops)
            ops.append(word)
            operand = True
        elif not operand and token == ")" and "(" in ops:
            while ops[-1] != "(":
                apply()
            ops.pop()
        else:
            break
    if operand:
        del ops[whole:]
    while ops and values:
        if ops[-1] == "(":
            ops.pop()
        else:
            apply()
    return values[-1] if values else None


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Phrases between blanks, as they stand in a sequence of words joined by single blanks."""
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, permissive) of one text."""
    words = text.translate(WORD_TABLE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, None
    line = f" {b' '.join(words).decode('latin-1')} "
    base, weight, starts, tags = set(), {}, [], []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    for end, phrase in automaton().iter(line):
        if phrase in BASE:
            base.add(BASE[phrase])
            starts.append(end - len(phrase) - 1)
            weight[BASE[phrase]] = max(weight.get(BASE[phrase], 0), BASE_WEIGHT)
        if phrase in NOTICES:
            label, w = NOTICES[phrase]
            weight[label] = max(weight.get(label, 0), w)
        if phrase == TAG:
            tags.append(end)
    permissive = None
    if tags:
        # as many words end before a tag's end as blanks stand before it; what stands behind a tag ends where the next one begins
        first, ends, _ = word_places(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        last = np.searchsorted(blanks, tags) - 1
        for at, stop in zip(ends[last].tolist(), [*first[last[1:] + 1 - len(TAG.split())].tolist(), len(text)], strict=True):
            if (m := TAGGED.match(text, at, max(at, stop))) and (value := evaluate(m[1].decode(errors="ignore"))):
                weight |= dict.fromkeys(value[0], TAG_WEIGHT)
                permissive = value[1] if permissive is None else permissive and value[1]
    ordinal = [int(np.searchsorted(blanks, s + 1)) - 1 for s in (min(starts), max(starts))] if starts else [None, None]
    score = 1 - float(np.prod([1 - w for w in weight.values()])) if weight else 0.0
    return len(words), len(starts), *ordinal, ",".join(sorted(base)), ",".join(sorted(weight)), score, permissive


COLUMNS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "permissive": pa.bool_()}


def scan_licenses(documents: DataFrame) -> DataFrame:
    """One row for every row of documents: word counts, base places and labels, all labels, a score (1 - product of (1 - weight) over the labels) and whether all tagged expressions are permissive (null without a tag).

    Null, empty and wordless texts have no words, no labels and score 0. Overlapping places all count. Repeated rows each get their row; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]):
        for rows, data, at in text_blocks(batches):
            found = [scan_text(data[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([row_of_batch(rows, "doc_id"), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), COLUMNS.values(), strict=True))], ["doc_id", *COLUMNS])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def base_sql() -> str:
    """The base columns in DuckDB, for the tests; labels, score and permissive are the method's own."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in BASE.items())
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER_AZ}', '{LOWER_AZ}'), '{WORD}') AS w FROM documents),
p(phrase, label, n) AS (VALUES {phrases}),
h AS (SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN p ON array_to_string(w[i:i + n - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""
