"""Spelling variants of the corpus' words, found by sorted permuterm rotations (operator 12)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import prepare, texts_of
from marquee.runtime import write_once

LEAST_LETTERS = 7
LEAST_COUNT = 2
FORM_TIMES = 10
DELETED_ONE_IN = 31
COUNTED_WORDS = 300_000
WHOLE_KEY = 64
EMITTED_ROWS = 50_000
# letters of the words in UTF-8: A-Z, a-z and U+00C0 to U+00FF; no byte of another character looks like them
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % LEAST_LETTERS)
_PRIME = (1 << 61) - 1
_BASES = (1_000_003_000_000_021, 900_000_000_000_007)


def runs_of(doc_id: int | None, text: bytes) -> Counter:
    """Words of one text with their counts, from ``LEAST_LETTERS`` letters on.

    Only A-Z are lower-cased. Where 31 divides the crc32 of "doc_id:run", the run loses the letter at crc32 modulo its length.
    """
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    found: Counter = Counter()
    for run, n in Counter(_RUN.findall(text.lower())).items():
        h = zlib.crc32(run, start)
        if not h % DELETED_ONE_IN:
            letters = run.decode()
            place = h % len(letters)
            if len(letters) <= LEAST_LETTERS:
                continue
            run = (letters[:place] + letters[place + 1 :]).encode()
        found[run] += n
    return found


def word_counts(df: DataFrame) -> DataFrame:
    """(word, n) over whole texts. Counts are added up inside a task, so a frequent word leaves it a few times only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                held.update(runs_of(doc_id, data[a:b].tobytes()))
                if len(held) >= COUNTED_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keys_of(word: str) -> Iterator[tuple[str, str | None, bool]]:
    """(key, skipped, again) for every rotation of ``word`` and its end mark, whole and without its last letter.

    ``again`` marks a skipped letter that follows one like it: the shorter word is then found where the first of them is skipped.
    Keys longer than ``WHOLE_KEY`` are given as two 61-bit hashes and their length, each from the one before in a few steps,
    so a word of very many letters takes time and room in proportion to its length.
    """
    size = len(word)
    if size < WHOLE_KEY:
        for i in range(size + 1):
            yield f"{word[i:]}${word[:i]}", None, False
            if i:
                yield f"{word[i:]}${word[: i - 1]}", word[i - 1], word[i - 2 : i - 1] == word[i - 1]
        return
    sums, powers = [], []
    for base in _BASES:
        s, p = [0], [1]
        for letter in word:
            s.append((s[-1] * base + ord(letter)) % _PRIME)
            p.append(p[-1] * base % _PRIME)
        sums.append(s)
        powers.append(p)

    def key(after: int, before: int) -> str:
        """Of the rotation word[after:] + "$" + word[:before]."""
        if size - after + 1 + before <= WHOLE_KEY:
            return f"{word[after:]}${word[:before]}"
        parts = []
        for s, p, base in zip(sums, powers, _BASES):
            tail = (s[size] - s[after] * p[size - after]) % _PRIME
            parts.append(((tail * base + ord("$")) * p[before] + s[before]) % _PRIME)
        return f"#{parts[0]:x}.{parts[1]:x}.{size - after + 1 + before}"

    for i in range(size + 1):
        yield key(i, i), None, False
        if i:
            yield key(i, i - 1), word[i - 1], word[i - 2 : i - 1] == word[i - 1]


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, again, id, n) of all ``words`` (word, id, n).

    The key is a rotation of the word and its end mark, or one without its last letter, which is ``skipped``. Words
    that differ in one letter share the key that skips it, and a word with a letter more shares its key with the
    whole rotation of the word without it.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["key", "skipped", "again", "id", "n"], [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
        held: list[tuple] = []
        for batch in batches:
            for word, own, n in zip(*[c.to_pylist() for c in batch.columns]):
                for key, skipped, again in _keys_of(word):
                    held.append((key, skipped, again, own, n))
                    if len(held) == EMITTED_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    return words.select("word", "id", "n").mapInArrow(turn, "key string, skipped string, again boolean, id long, n long")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best): how many words are near each one that has any, and the most frequent of its neighbourhood.

    All rotations are sorted once, by range; the words of one key stand next to each other. They are as many as there are
    letters and one more, whatever the size of the corpus, and all near each other, so a scan adds up each key's numbers
    and no pair is written. A word itself counts for its ``best``, which does no harm: nothing is ten times as frequent as itself.
    """
    ordered = rotations(words).repartitionByRange("key").sortWithinPartitions("key")
    same = Window.partitionBy("key")
    whole = F.col("skipped").isNull()
    scanned = ordered.select(
        "id", "again", whole.alias("whole"), F.count(F.lit(1)).over(same).alias("all"),
        F.max(whole.cast("long")).over(same).alias("wholes"), F.sum(F.col("again").cast("long")).over(same).alias("agains"),
        F.min(F.struct((-F.col("n")).alias("n"), "id")).over(same).alias("best"),
    ).filter("all > 1")
    # a word and one with a letter more meet under each of several equal letters; only the first of these counts
    others = F.col("all") - 1 - F.when(F.col("whole"), F.col("agains")).when(F.col("again"), F.col("wholes")).otherwise(0)
    return scanned.groupBy("id").agg(F.sum(others).alias("n_near"), F.min("best").alias("best")).select(
        "id", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.id").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): where following forms ends. Each round doubles the step; a form is ten times as frequent
    as its word, so the rounds are as few as the logarithm of the number of digits of the greatest count."""
    now = write_once(forms.select("id", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("id").alias("root"), F.col("root").alias("_further"))
        joined = write_once(now.join(step, "root", "left").select("id", F.coalesce("_further", "root").alias("root"), "_further"))
        now = joined.select("id", "root")
        if joined.filter("_further is not null").isEmpty():
            return now


def spelling_variants(df: DataFrame) -> DataFrame:
    """Per word: (word, form, root, n, n_near, form_n).

    Words are the runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, some of them less a letter
    (see ``runs_of``), that have seven letters and stand twice or more in the corpus. Two are near if one
    inserted, deleted or replaced letter makes one of the other. The form of a word is its most frequent near word, the
    first in code-point order of equals, if that is ten times as frequent or more; the root is where following
    forms ends, the word itself if it has no form.

    Words are numbered in code-point order, so rotations, ties and forms need only numbers. Hot words are added up inside tasks; the
    sorted rotations of a key are bounded by the alphabet; nothing is broadcast or collected.

    A null or empty text has no words; a null doc_id is written as nothing before the colon. Repeated rows count again.
    An empty table gives no rows. Runs of any length are handled (see ``_keys_of``). Other columns play no part.
    """
    prepare(df.sparkSession)
    counted = word_counts(df).filter(F.col("n") >= LEAST_COUNT)
    words = write_once(
        counted.repartitionByRange("word").sortWithinPartitions("word").withColumn("id", F.monotonically_increasing_id())
    )
    near = words.join(near_words(words), "id", "left")
    often = F.col("best_n") >= FORM_TIMES * F.col("n")
    found = write_once(near.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best")).alias("form_id"), F.when(often, F.col("best_n")).alias("form_n"),
    ))
    ends = roots(found.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    names = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    forms = names.withColumnsRenamed({"_id": "form_id", "_word": "form"})
    last = names.withColumnsRenamed({"_id": "root", "_word": "root_word"})
    return (
        found.join(ends, "id", "left").join(forms, "form_id", "left").join(last, "root", "left")
        .select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
    )
