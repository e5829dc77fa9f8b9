"""Texts that hold residue of a template or an error page where content belongs.

A naive Bayes model with three classes of passages (unfilled, junk, real) is learned from positive and
unlabelled records by expectation-maximisation. Passages of a few trusted kinds are the positives: records
with several open places of a form, and records that carry an unmistakable error line, script notice or
run of filler. All other passages are unlabelled; their classes are estimated, round by round, from all
passages of all records. A record is residue if a passage of it is, and an exact check on that passage
bears it out: an unfilled passage must hold an open place that isn't quoted, a junk passage must not be
outweighed by real ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallgrass.plans.staging import release, stage

UNFILLED, JUNK = 1, 2

# The notations of a place to be filled in. INNER is what may stand between the marks.
INNER = r"[^\W\d][\w .:…/-]*?"
SLOTS = [
    r"\{\{\s*[\w .]+\s*\}\}", r"\{%\s*[\w .]+\s*%\}", r"<%=?\s*[\w .]+\s*%>", r"<!--\s*[\w .]+\s*-->",
    r"\[\[\s*[\w .]+\s*\]\]", r"<<\s*[\w .]+\s*>>", r"\$\{[\w .]+\}", r"\$\([\w .]+\)", r"\{\w+\}",
    rf"<{INNER}>", rf"&lt;{INNER}&gt;", rf"«{INNER}»", rf"‹{INNER}›", rf"\[{INNER}\]", r"\[…\]|\[\.\.\.\]|\[\s*\]",
    r"%[A-Z][A-Z_]+%", r"(?<![\w%])%[sd]\b", r"#[A-Za-z][A-Za-z_]+#", r"@@?[A-Za-z][A-Za-z_]+@@?", r"&[A-Z][A-Z_]+&",
    r"~[A-Za-z][A-Za-z_]+~", r"__[A-Za-z][A-Za-z_]*?__", r"_{3,}", r"\b[Xx]{2,4}[./-][Xx]{2,4}[./-][Xx]{2,4}\b", r"\bnull_\w+", r"\((?:enter|insert|fill in|your) [\w .]+\)",
]
SLOT = re.compile("|".join(f"(?:{s})" for s in SLOTS))
QUOTES_BEFORE, QUOTES_AFTER = "\"'“”„‘’‚`", "\"'“”‘’`"

# What a passage must hold for an open place to be possible at all.
SIGN_CLASS, SIGN_WORDS = r"[{}<>\[\]$%#@&~«‹_(]", ["xx"]
SLOT_SIGN = re.compile("|".join([SIGN_CLASS, *map(re.escape, SIGN_WORDS)]), re.I)

# Unmistakable openings of error lines with their first words, and names of scripting in a browser.
ERROR_WORDS = ["error", "fehler", "erreur", "http", "oops", "sorry"]
ERROR_LINE = re.compile(r"\W*(?:(?:error|fehler|erreur|http status)\s*\d{3}\s*[:–-]|oops!|sorry, |\d{3}\s+[-–]\s+\w)", re.I)
SCRIPT = re.compile(r"\b(?:java ?script|noscript|(?:active |client-side )scripting|script support)\b", re.I)
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"
INLINE = r" \t\r\x0b\f\x85\xa0"
#: Passages end behind the end of a sentence, and with a line.
SPLIT = rf"(?<=[.!?…])[{INLINE}\n]+|[{INLINE}]*\n[{INLINE}\n]*"
WORD = r"[\p{L}\p{Nl}\p{No}]+"
PYTHON_WORD = re.compile(r"[^\W\d_]+")
MARKS = ["§slot", "§quoted", "§rare", "§number", "§run", "§short", "§long"]
LONGEST_PERIOD = 6


def slots_of(passage: str) -> tuple[int, int, str]:
    """Open places not in quotes, places in quotes, and the passage without both."""
    if not SLOT_SIGN.search(passage):
        return 0, 0, passage
    bare = quoted = 0
    rest, at = [], 0
    for m in SLOT.finditer(passage):
        before, after = passage[: m.start()].rstrip()[-1:], passage[m.end() :].lstrip()[:1]
        if before and before in QUOTES_BEFORE and after and after in QUOTES_AFTER:
            quoted += 1
        else:
            bare += 1
        rest.append(passage[at : m.start()])
        at = m.end()
    return bare, quoted, " ".join([*rest, passage[at:]])


def has_run(words: list) -> bool:
    """Whether a phrase of up to LONGEST_PERIOD words stands three times in a row."""
    if len(set(words)) * 3 > len(words) * 2:
        return False
    for k in range(1, LONGEST_PERIOD + 1):
        streak = 0
        for x, y in zip(words, words[k:]):
            streak = streak + 1 if x == y else 0
            if streak >= 2 * k:
                return True
    return False


def hash_word(word: str) -> int:
    """The hash that ``xxhash64`` gives a word on the JVM."""
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


#: Share of a record's passages that are trusted junk, from which all its passages without open places are.
TRUSTED_SHARE = 0.125
#: Different words, and share of words that hardly any other record has, from which a passage is trusted to be noise.
LEAST_NOISE, NOISE_SHARE = 5, 0.5
#: Passages with open places from which a record is trusted to be an unfilled form.
UNFILLED_PASSAGES = 3



def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def passages(slim: DataFrame) -> DataFrame:
    """(id, line, hash, words, size, digits, first): a row per passage of ``slim`` (id, text), those of a record one after another.

    ``words`` are hashed. ``line`` is there only where Python has to read the passage: where an open place is
    possible, or an error line or script notice, which begin with certain words or with no word at all.
    """
    rows = slim.select("id", F.posexplode(F.split(F.btrim("text", F.lit(BLANKS)), SPLIT)).alias("n", "line")).where("line <> ''")
    rows = rows.select("*", F.lower("line").alias("lower"), _words(F.col("line")).alias("found"))
    line, lower, first = F.col("line"), F.col("lower"), F.get("found", F.lit(0))
    sign = line.rlike(SIGN_CLASS)
    for w in [*SIGN_WORDS, "script"]:
        sign = sign | F.contains(lower, F.lit(w))
    opening = first.isNull() | first.isin(*ERROR_WORDS) | ~F.startswith(lower, first)
    return rows.select(
        "id", F.when(sign | opening, line).alias("line"), _hashed(F.col("found")).alias("words"), F.length("line").alias("size"),
        line.rlike("[0-9]").alias("digits"), F.xxhash64("line").alias("hash"), (F.col("n") == 0).alias("first"),
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), sizes)


#: Rows of packed passages, each a megabyte or more, that are written and read together.
GROUP_ROWS = 4


class Packed:
    """Arrays of some thousand passages; in a table they are one row of binary values, which pass through Spark untouched."""

    @classmethod
    def kinds(cls) -> dict[str, type]:
        return {f.name: f.metadata["kind"] for f in fields(cls)}

    @classmethod
    def columns(cls) -> str:
        return ", ".join(f"{n} binary" for n in cls.kinds())

    @classmethod
    def read(cls, batches: Iterator[pa.RecordBatch]) -> Iterator:
        for b in batches:
            for i in range(len(b)):
                yield cls(*[np.frombuffer(b.column(k)[i].as_py(), t) for k, t in enumerate(cls.kinds().values())])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([getattr(self, n).astype(t).tobytes()], pa.binary()) for n, t in self.kinds().items()], names=list(self.kinds()))


def _kind(t: type):
    return field(metadata={"kind": t})


@dataclass
class Words(Packed):
    """Passages as read: ``record`` numbers the records, ``mark`` has a bit per mark, ``word`` the hashes of the ``n_words`` different words."""

    id: np.ndarray = _kind(np.int64)
    record: np.ndarray = _kind(np.int32)
    bare: np.ndarray = _kind(np.int32)
    size: np.ndarray = _kind(np.int32)
    label: np.ndarray = _kind(np.int32)
    mark: np.ndarray = _kind(np.int32)
    n_words: np.ndarray = _kind(np.int32)
    word: np.ndarray = _kind(np.int64)


@dataclass
class Block(Packed):
    """Passages by the features of the vocabulary."""

    id: np.ndarray = _kind(np.int64)
    bare: np.ndarray = _kind(np.int32)
    size: np.ndarray = _kind(np.int32)
    label: np.ndarray = _kind(np.int32)
    n_features: np.ndarray = _kind(np.int32)
    feature: np.ndarray = _kind(np.int32)

    @property
    def row(self) -> np.ndarray:
        """The passage of each feature."""
        return np.repeat(np.arange(len(self.id)), self.n_features)

    def keep(self, mask: np.ndarray) -> Block:
        return Block(self.id[mask], self.bare[mask], self.size[mask], self.label[mask], self.n_features[mask], self.feature[np.repeat(mask, self.n_features)])


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end with a record's last passage."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
        if len(starts):
            if ready := [*held, *([batch.slice(0, starts[-1])] if starts[-1] else [])]:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
            held = [batch.slice(starts[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _together(group: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """An order in which equal hashes of a group (a number below 2^20) stand together: by group and the upper 44 bits of the hash.

    Different hashes of a group that share those bits, one pair in 10^13, may stand mixed; a word then counts twice.
    """
    if len(group) and group.max() >= 1 << 20:
        return np.lexsort((hashes, group))
    return np.argsort(group.astype(np.uint64) << np.uint64(44) | hashes.view(np.uint64) >> np.uint64(20))


def _thrice(hashes: np.ndarray, record: np.ndarray) -> np.ndarray:
    """Which passages are one of three equal ones in a row of a record."""
    out = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        same = (hashes[:-1] == hashes[1:]) & (record[:-1] == record[1:])
        first = np.flatnonzero(same[:-1] & same[1:])
        for k in (0, 1, 2):
            out[first + k] = True
    return out


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages (see :func:`passages`) as :class:`Words`: open places taken out, marks set, trusted ones labelled."""
    for b in _whole_records(batches):
        n = len(b)
        record = np.cumsum(b.column("first").to_numpy(zero_copy_only=False)) - 1
        flat, row = _flat(b.column("words"))
        size_, digits = b.column("size").to_numpy().copy(), b.column("digits").to_numpy(zero_copy_only=False).copy()
        trusted, run = np.zeros(n, dtype=bool), _thrice(b.column("hash").to_numpy(), record)
        bare, quoted = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        # Passages that may hold open places are read again without them; these are few.
        again: list[np.ndarray] = []
        replaced = np.zeros(n, dtype=bool)
        lines = b.column("line")
        at = np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False))
        for i, line in zip(at, lines.take(pa.array(at)).to_pylist()):
            bare[i], quoted[i], rest = slots_of(line)
            if bare[i] or quoted[i]:
                found = PYTHON_WORD.findall(rest.lower())
                replaced[i], size_[i], digits[i] = True, len(rest), re.search(r"\d", rest) is not None
                again.append(np.array([[i, hash_word(w)] for w in found], dtype=np.int64).reshape(-1, 2))
            trusted[i] = ERROR_LINE.match(line) is not None or (not digits[i] and SCRIPT.search(line) is not None)
        if again:
            more = np.concatenate(again)
            kept = ~replaced[row]
            flat, row = np.concatenate([flat[kept], more[:, 1]]), np.concatenate([row[kept], more[:, 0]])
            order = np.argsort(row, kind="stable")
            flat, row = flat[order], row[order]
        n_found = np.bincount(row, minlength=n)
        # One row per different word of a passage.
        order = _together(row, flat)
        word, at_row = flat[order], row[order]
        first = np.ones(len(flat), dtype=bool)
        first[1:] = (at_row[1:] != at_row[:-1]) | (word[1:] != word[:-1])
        word, at_row = word[first], at_row[first]
        n_words = np.bincount(at_row, minlength=n)
        starts = np.concatenate([[0], np.cumsum(n_found)])
        for i in np.flatnonzero((n_found > 2) & (3 * n_words <= 2 * n_found)):
            run[i] |= has_run(flat[starts[i] : starts[i + 1]].tolist())
        marks = [bare > 0, quoted > 0, np.zeros(n, bool), digits, run, n_found <= 3, n_found > 40]
        # Labels of trusted passages and records.
        trusted |= run
        form = (np.bincount(record, bare > 0) >= UNFILLED_PASSAGES)[record]
        page = (np.bincount(record, trusted) >= np.maximum(TRUSTED_SHARE * np.bincount(record), 1e-9))[record]
        label = np.where(form & (bare > 0), UNFILLED, np.where(trusted | (page & (bare == 0)), JUNK, -1))
        yield Words(b.column("id").to_numpy(), record, bare, np.where(n_found > 0, size_, 0), label, sum(m.astype(np.int32) << k for k, m in enumerate(marks)), n_words, word).batch()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, k): how many records of a block have each word."""
    for b in Words.read(batches):
        record, word = np.repeat(b.record, b.n_words), b.word
        order = _together(record, word)
        record, word = record[order], word[order]
        new = np.ones(len(word), dtype=bool)
        new[1:] = (record[1:] != record[:-1]) | (word[1:] != word[:-1])
        words, k = np.unique(word[new], return_counts=True)
        if len(words):
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(k.astype(np.int64))], names=["w", "k"])


def _encoder(vocabulary: np.ndarray):
    """Features of passages: the marks, then the words of the (sorted, hashed) vocabulary; all other words are one feature."""
    size, rare = len(MARKS) + len(vocabulary), MARKS.index("§rare")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in Words.read(batches):
            n, row = len(b.id), np.repeat(np.arange(len(b.id)), b.n_words)
            at = np.minimum(np.searchsorted(vocabulary, b.word), max(0, len(vocabulary) - 1))
            known = vocabulary[at] == b.word if len(vocabulary) else np.zeros(len(b.word), bool)
            parts = [row * size + np.where(known, at + len(MARKS), rare), *[np.flatnonzero(b.mark >> k & 1) * size + k for k in range(len(MARKS))]]
            keys = np.unique(np.concatenate(parts).astype(np.int64))
            noise = (b.n_words >= LEAST_NOISE) & (np.bincount(row, ~known, n) >= NOISE_SHARE * b.n_words) & (b.bare == 0)
            yield Block(b.id, b.bare, b.size, np.where(noise, JUNK, b.label), np.bincount(keys // size, minlength=n), keys % size).batch()

    return encode


@dataclass
class Model:
    """Log-odds of the positive class: a constant and a weight per feature of the bounded vocabulary."""

    weight: np.ndarray
    constant: float

    def odds(self, b: Block) -> np.ndarray:
        return self.constant + np.bincount(b.row, self.weight[b.feature], len(b.id))


@dataclass
class Counts:
    """Passages with each feature, and passages, per class (negative, positive)."""

    table: np.ndarray
    number: np.ndarray


def _expected(blocks: DataFrame, size: int, model: Model | None, open_: bool = False) -> Counts:
    """Expected counts per class of the passages with (``open_``) or without open places; trusted ones are positives. Summed in the tasks first.

    Passages with open places are judged by the mean log-odds of their features.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = np.zeros((2, size)), np.zeros(2)
        for b in Block.read(batches):
            b = b.keep((b.bare > 0) == open_)
            p = np.zeros(len(b.id))
            if model is not None:
                p = 1 / (1 + np.exp(-np.clip(model.odds(b) / (np.maximum(1, b.n_features) if open_ else 1), -500, 500)))
            p[b.label > 0] = 1.0
            row = b.row
            positive = np.bincount(b.feature, p[row], size)
            table[1] += positive
            table[0] += np.maximum(0.0, np.bincount(b.feature, minlength=size) - positive)
            number += [(1 - p).sum(), p.sum()]
        f = np.flatnonzero(table.sum(axis=0))
        columns = [pa.array(np.concatenate([[-1], f]), pa.int32()), *[pa.array(np.concatenate([[number[c]], table[c, f]])) for c in (0, 1)]]
        yield pa.RecordBatch.from_arrays(columns, names=["f", "c0", "c1"])

    partial = blocks.mapInArrow(count, "f int, c0 double, c1 double")
    got = Counts(np.zeros((2, size)), np.zeros(2))
    for f, c0, c1 in partial.groupBy("f").agg(F.sum("c0"), F.sum("c1")).collect():  # a row per word of the bounded vocabulary
        if f < 0:
            got.number[:] = c0, c1
        else:
            got.table[:, f] = c0, c1
    return got


def fit(counts: Counts, usual: np.ndarray, lend: float = 0.0, common: float = 1.0, prior: Model | None = None) -> Model | None:
    """Naive Bayes weights from expected counts; None without positives.

    Both classes are smoothed with one passage of the ``usual`` shares, so a word unseen in the few positives
    counts for as little as it is rare. ``lend`` adds as many usual passages to the positives as it is times
    their number: for positives that are ordinary passages but for what marks them. Words of more than
    ``common`` of all passages are left out; they tell the language rather than what is said. The weights of
    ``prior`` are added to those learned.
    """
    table, number = counts.table, counts.number
    if number[1] < 0.5:
        return None
    extra = np.array([1.0, 1.0 + lend * number[1]])
    logp = np.log(table + extra[:, None] * np.maximum(usual, 1e-9)) - np.log(number + extra)[:, None]
    weight = logp[1] - logp[0]
    weight[table.sum(axis=0) == 0] = 0.0
    weight[usual > common] = 0.0
    weight[MARKS.index("§slot")] = 0.0
    if prior is not None:
        weight += prior.weight
    return Model(weight, float(np.log(number[1] + 0.5) - np.log(number[0] + 0.5)))


def familiar(usual: np.ndarray, common: float, level: float) -> Model:
    """A first guess at which passages are ordinary but for their open places: their words are usual ones.

    A word counts for ordinary if more than ``level`` of all passages have it, and against it if fewer do.
    """
    weight = np.log(np.maximum(usual, level / 50) / level)
    weight[usual > common] = 0.0
    weight[: len(MARKS)] = 0.0
    weight[MARKS.index("§rare")] = -1.5
    return Model(weight, 0.0)


def learn_unfilled(opened: DataFrame, usual: np.ndarray, rounds: int, common: float, level: float) -> Model | None:
    """Which passages with open places are unfilled, and which are about such places.

    The classes are of like size here. The rounds estimate with the mean log-odds of a passage's features,
    which keeps them from settling on the first guess.
    """
    prior = model = familiar(usual, common, level)
    for _ in range(rounds + 1):
        model = fit(_expected(opened, len(usual), model, open_=True), usual, 1.0, common, prior)
        if model is None:
            return None
    return model


def learn_junk(blocks: DataFrame, everything: Counts, usual: np.ndarray, rounds: int) -> Model | None:
    """Which passages without open places are junk. All unlabelled ones start as real; each round re-estimates all of them."""
    model = fit(everything, usual)
    for _ in range(rounds if model is not None else 0):
        model = fit(_expected(blocks, len(usual), model), usual)
    return model


def find_residue(
    records: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    least_share: float = 5e-4,
    max_words: int = 200_000,
    rounds: int = 6,
    open_rounds: int = 6,
    common: float = 0.02,
    level: float = 1e-3,
) -> DataFrame:
    """(id, kind, odds, share): the records that hold residue.

    kind is ``unfilled`` (a place was never filled in) or ``junk`` (filler, an error page, a script notice).
    Two models are learned: which passages with open places are unfilled rather than about such places, and
    which other passages are junk rather than real. A record is unfilled if a passage of it is, and junk if
    the log-odds of its passages without open places sum to more than 0; odds is the largest or the sum,
    share the part of the record's characters in passages found to be residue. A place in quotes is never open,
    and passages without words decide nothing.

    ``id`` is a bigint. Words of fewer than ``least_share`` of all records count as one feature, as do those
    beyond the ``max_words`` most frequent. Null and blank texts hold no residue; texts are read whole;
    repeated rows give one result row; an empty table gives none; columns not named are not read.
    """
    slim = records.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.btrim("text", F.lit(BLANKS)) != ""))
    read = stage(passages(slim).mapInArrow(_read_words, Words.columns()), "words", GROUP_ROWS)
    least = max(2.0, least_share * slim.count())
    frequent = read.mapInArrow(_word_counts, "w bigint, k bigint").groupBy("w").agg(F.sum("k").alias("k")).where(F.col("k") >= least)
    words = sorted(r[0] for r in frequent.orderBy(F.desc("k"), "w").limit(max_words).collect())
    blocks = stage(read.mapInArrow(_encoder(np.array(words, dtype=np.int64)), Block.columns()), "passages", GROUP_ROWS)
    release(read)
    size = len(MARKS) + len(words)

    def with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in Block.read(batches):
            yield b.keep(b.bare > 0).batch()

    opened = stage(blocks.mapInArrow(with_places, Block.columns()), "open-places", GROUP_ROWS)
    everything = _expected(blocks, size, None)
    usual = everything.table.sum(axis=0) / max(1.0, everything.number.sum())
    unfilled = learn_unfilled(opened, usual, open_rounds, common, level)
    junk = learn_junk(blocks, everything, usual, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums per record and block; a block ends with a record, but rows of one id may stand apart."""
        for b in Block.read(batches):
            bare = b.bare > 0
            of_open = unfilled.odds(b) if unfilled is not None else np.full(len(b.id), -np.inf)
            of_closed = junk.odds(b) if junk is not None else np.full(len(b.id), -1.0)
            ids, at = np.unique(b.id, return_inverse=True)
            most = np.full(len(ids), -np.inf)
            np.maximum.at(most, at[bare], of_open[bare])
            counted = ~bare & (b.size > 0)
            hit = np.where(bare, of_open, of_closed) > 0
            total = lambda x: np.bincount(at, x, len(ids))  # noqa: E731, B023
            closed = total(np.where(counted, of_closed, 0.0))
            found = (closed > 0) | (most > 0)
            columns = [ids, most, closed, total(np.where(hit, b.size, 0)), total(b.size)]
            yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in columns], names=["id", "most", "closed", "residue", "size"])

    scored = blocks.mapInArrow(score, "id bigint, most double, closed double, residue double, size double")
    # A record delivered several times has the same sums each time.
    by_record = scored.groupBy("id").agg(F.max("most").alias("most"), F.max("closed").alias("closed"), F.max(F.col("residue") / F.greatest("size", F.lit(1.0))).alias("share"))
    is_junk = F.col("closed") > 0
    found = by_record.select(F.col("id").alias(id), F.when(is_junk, "junk").otherwise("unfilled").alias("kind"), F.when(is_junk, F.col("closed")).otherwise(F.col("most")).alias("odds"), "share")
    out = stage(found, "residue")
    release(blocks, opened)
    return out
