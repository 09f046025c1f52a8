"""One form for texts that look the same: equal looks become equal strings.

Method: normalization quick-check properties isolate the unstable segments of a text (characters that
do not pass NFC's quick check, combining marks, compatibility forms, blanks, invisible characters and
look-alike letters); only those segments, with the preceding base character as boundary context, are
normalised, and the canonical segments are spliced into the unchanged text.

This gives the folded form, in which look-alike letters are Latin: the key of comparisons. The canonical form
is made from it alone, so equal looks stay equal strings: a word with letters that only another script has gets
its look-alike letters back in that script, and so does a word of look-alikes only, without digit or underscore, where
that script prevails in the text. Look-alikes are the letters below and those of the public confusables data that ships with Spark (ICU).

Kept apart, as they differ visibly: case, accents, digits, punctuation, line breaks, superscripts,
fractions and styled letters. Runs of blanks keep their length.
"""

from __future__ import annotations

import functools
import glob
import os
import re
import struct
import sys
import unicodedata as ud
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyspark
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.runtime import cut, worker_cache

# Letters of other scripts and the Latin letter of equal look.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԁ": "d", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    "Ӕ": "Æ", "ӕ": "æ", "Ә": "Ə", "ә": "ə", "Ӡ": "Ʒ", "ӡ": "ʒ",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U",
    # Letters of Latin itself
    "ɡ": "g", "ǃ": "!", "ꞌ": "'",
}
# Hyphens that look like the ASCII one.
HYPHENS = "‐‑֊﹣－᠆"
# Invisible characters outside the category of format characters.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏⁥ㅤﾠ"
#: Kinds of compatibility decomposition that change no look, and ranges where others change none either.
SAME_LOOK_KINDS = ("<wide>", "<narrow>", "<noBreak>")
SAME_LOOK_RANGES = ((0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x2160, 0x217F), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133))
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
LINE_BREAKS = "\n\r\x0b\x0c\x85  "


#: Copies of a string's row over which the documents of a hot string are spread in a join.
SALTS = 8
#: Where the public confusables data lies in the ICU archive that Spark ships.
CONFUSABLES = "com/ibm/icu/impl/data/icudata/confusables.cfu"


@functools.cache
def script(c: str) -> str:
    """Script of a letter: the first word of its name."""
    return ud.name(c, "?").split()[0]


def prototypes() -> tuple[str, dict[str, str]]:
    """Version of the public confusables data, and the prototype of each character in it.

    The file is a header, a list of keys (length of the prototype less 1 in the top byte, then the code point), a list
    of values (the prototype itself if it is one UTF-16 unit, else its place among the strings) and the strings.
    """
    archive = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "icu4j-*.jar")) + glob.glob(os.path.join(os.environ.get("SPARK_HOME", ""), "jars", "icu4j-*.jar")))
    if not archive:
        return "none", {}
    with zipfile.ZipFile(archive[0]) as z:
        raw = z.read(CONFUSABLES)
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    at = struct.unpack(">9i", body[:36])
    keys = struct.unpack(f">{at[4]}I", body[at[3] : at[3] + 4 * at[4]])
    places = struct.unpack(f">{at[6]}H", body[at[5] : at[5] + 2 * at[6]])
    units = body[at[7] : at[7] + 2 * at[8]]
    text = lambda p, n: units[2 * p : 2 * (p + n)].decode("utf-16-be", "replace") if n > 1 else chr(p)
    return os.path.basename(archive[0])[:-4], {chr(k & 0xFFFFFF): text(p, (k >> 24) + 1) for k, p in zip(keys, places)}


@functools.cache
def confusable_letters() -> dict[str, str]:
    """Letters of other scripts and the Latin letter they look like.

    LOOK_ALIKE, and from the public data each left-to-right letter without decomposition whose prototype is one letter
    that a Latin letter of the same case shares. Letters of one script do not fall together, but for a few of equal
    shape in the list: where two would, the listed one or else the lower code point is taken.
    """
    out, known = dict(LOOK_ALIKE), prototypes()[1]
    case = lambda c: ud.category(c) if ud.category(c) in ("Lu", "Ll") else None
    latin: dict[str, list[str]] = {}
    for c in map(chr, range(0x250)):
        if script(c) == "LATIN" and case(c):
            latin.setdefault(known.get(c, c), []).append(c)
    taken = {(script(a), b) for a, b in out.items()}
    for c, form in sorted(known.items()):
        if c in out or len(form) != 1 or ud.category(c) not in ("Lu", "Ll", "Lo") or ud.decomposition(c) or ud.bidirectional(c) != "L" or script(c) in ("LATIN", "?"):
            continue
        fits = [x for x in latin.get(form, ()) if case(c) in (None, case(x))]
        if fits and (script(c), fits[0]) not in taken:
            out[c] = fits[0]
            taken.add((script(c), fits[0]))
    return out


def build_tables(letters: dict[str, str]) -> tuple[dict[int, str], tuple[re.Pattern, re.Pattern], re.Pattern]:
    """Replacements by code point, and the patterns of unstable segments and of characters that join with the one before."""
    table: dict[int, str] = {ord(a): b for a, b in letters.items()}
    table |= {ord(c): "-" for c in HYPHENS} | {ord(c): "" for c in INVISIBLE}
    joining, unstable = [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x17000 <= cp <= 0x1CFFF or 0x20000 <= cp <= 0x2F7FF or 0x2FA20 <= cp <= 0xE00FF or cp >= 0xE01F0:
            continue  # ideographs, syllables, surrogates, private use and unassigned planes are stable
        c = chr(cp)
        kind = ud.category(c)
        if cp not in table and c not in LINE_BREAKS:
            form = ud.decomposition(c)
            if kind == "Zs":
                table[cp] = " "
            elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
                table[cp] = ""
            elif form.startswith(SAME_LOOK_KINDS) or (form.startswith("<compat>") and any(a <= cp <= b for a, b in SAME_LOOK_RANGES)):
                table[cp] = ud.normalize("NFKC", c) if kind != "Lm" else ud.normalize("NFKD", c)
        if ud.combining(c) or kind in ("Mn", "Mc") or not ud.is_normalized("NFC", c) or 0x1161 <= cp <= 0x11FF:
            joining.append(cp)
        elif cp in table:
            unstable.append(cp)
    table[0x09] = " "
    for cp in [0xFF9E, 0xFF9F]:
        joining.append(cp)
    # a base letter whose own decomposition holds a look-alike letter, such as an accented Cyrillic one
    for cp in range(0xC0, 0x2000):
        form = ud.normalize("NFD", chr(cp))
        if len(form) > 1 and ord(form[0]) in table:
            unstable.append(cp)
    # replacements are themselves replaced where needed (a wide form of a blank, say)
    for cp, text in table.items():
        table[cp] = "".join(table.get(ord(x), x) for x in text)
    cls = lambda cps: "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans(sorted(set(cps))))
    every = [*joining, *unstable, 0x09]
    # a class within the basic plane compiles to a bitmap; the full one, a list of ranges, serves the rare other texts
    return table, (re.compile(f"[{cls(c for c in every if c < 0x10000)}]+"), re.compile(f"[{cls(every)}]+")), re.compile(f"[{cls(joining)}]")


def spans(cps: list[int]) -> list[tuple[int, int]]:
    """Closed intervals of a sorted list of code points."""
    out: list[tuple[int, int]] = []
    for c in cps:
        if out and out[-1][1] == c - 1:
            out[-1] = (out[-1][0], c)
        else:
            out.append((c, c))
    return out


def canonical_segment(segment: str, table: dict[int, str]) -> str:
    """Canonical form of an unstable segment: decompose, replace, compose, until it stays."""
    for _ in range(4):
        new = ud.normalize("NFC", ud.normalize("NFD", segment.translate(table)).translate(table))
        if new == segment:
            break
        segment = new
    return segment


WORD = re.compile(r"[\w\u0300-\u036f\u0483-\u0487]+")


class Look:
    """Folded and canonical forms under one set of look-alike letters, with a memory of segments and words."""

    def __init__(self, letters: dict[str, str]):
        self.table, (self.basic, self.full), self.joins = build_tables(letters)
        self.memory: dict[str, str | None] = {}
        self.words: dict[str, tuple] = {}
        self.back: dict[str, dict[str, str]] = {}
        for a, b in letters.items():
            if script(a) != "LATIN" and len(b) == 1 and ud.category(a) in ("Lo", ud.category(b)):
                self.back.setdefault(script(a), {}).setdefault(b, a)
        own = [cp for cp in range(0x250, 0x1100) if chr(cp) not in letters and script(chr(cp)) in self.back and ud.category(chr(cp))[0] == "L"]
        own += [cp for cp in (*range(0x10A0, 0x2000), *range(0x2C00, 0x2E00), *range(0xA000, 0xAC00)) if chr(cp) not in letters and script(chr(cp)) in self.back and ud.category(chr(cp))[0] == "L"]
        self.anchor = re.compile(f"[{''.join(f'{re.escape(chr(a))}-{re.escape(chr(b))}' for a, b in spans(own))}]")

    def fold(self, text: str) -> str:
        """The key of a text's look: look-alike letters are Latin. A text of ASCII characters without tab is unchanged."""
        if text.isascii() and "\t" not in text:
            return text.replace("\r\n", "\n") if "\r" in text else text
        table, joins, memory = self.table, self.joins, self.memory
        pattern = self.full if ASTRAL.search(text) else self.basic
        pieces, done = [], 0
        for m in pattern.finditer(text):
            start, end = m.span()
            segment = m[0]
            new = memory.get(segment, segment)
            if new is segment:  # not known yet: canonical on its own, or None if it joins with what stands before
                new = None if joins.search(segment) else canonical_segment(segment, table)
                if len(segment) <= 40 and len(memory) < 200_000:
                    memory[segment] = new
            if new is None:
                if start > done:
                    start -= 1
                new = canonical_segment(text[start:end], table)
            pieces.append(text[done:start])
            pieces.append(new)
            done = end
        pieces.append(text[done:])
        out = "".join(pieces)
        if not ud.is_normalized("NFC", out):
            out = canonical_segment(out, table)
        return out.replace("\r\n", "\n") if "\r" in out else out

    def _word(self, word: str) -> tuple[Counter, Counter]:
        """Letters of a folded word: those that only another script has, by script, and Latin ones."""
        known = self.words.get(word)
        if known is None:
            own, latin = Counter(), Counter()
            for c in ud.normalize("NFD", word):
                if c.isalpha():
                    if script(c) == "LATIN":
                        latin[c] += 1
                    else:
                        own[script(c)] += 1
            known = own, latin
            if len(word) <= 40 and len(self.words) < 200_000:
                self.words[word] = known
        return known

    def canonical(self, text: str) -> str:
        """The one form of a text's look, each word in its own script."""
        text = self.fold(text)
        if text.isascii() or not self.anchor.search(text):
            return text
        words = [(m.span(), *self._word(m[0])) for m in WORD.finditer(text)]
        count = Counter()
        for _, own, latin in words:
            if len(own) == 1:
                count[next(iter(own))] += sum(own.values()) + sum(latin.values())
        main = max((s for s in count if s in self.back), key=lambda s: (count[s], s), default=None)
        if main is not None and count[main] <= sum(sum(latin.values()) for _, own, latin in words if not own and any(c not in self.back[main] for c in latin)):
            main = None  # words that only Latin can write prevail
        pieces, done = [], 0
        for (start, end), own, latin in words:
            name = next(iter(own)) if len(own) == 1 else main if not own and text[start:end].replace("\u0301", "").isalpha() else None
            back = self.back.get(name)
            if back and latin and all(c in back for c in latin):
                pieces += [text[done:start], ud.normalize("NFC", "".join(back.get(c, c) for c in ud.normalize("NFD", text[start:end])))]
                done = end
        return "".join([*pieces, text[done:]])


def look_of(letters: dict[str, str]) -> Look:
    """The forms under these letters, made once for each Python worker."""
    cache = worker_cache()
    key = ("same_look", len(letters), hash(tuple(sorted(letters.items()))))
    if key not in cache:
        cache[key] = Look(letters)
    return cache[key]


def digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def canonical_documents(documents: DataFrame) -> DataFrame:
    """doc_id, text (in its one form; null stays null), changed, look (128-bit key of the folded form, in hex): one row
    for each document. Texts of equal look get equal strings and keys."""
    docs, letters = documents.select("doc_id", F.col("text").cast("string").alias("text")), confusable_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = look_of(letters)
        for b in batches:
            raw = b.column(1).to_pylist()
            new = [None if t is None else look.canonical(t) for t in raw]
            keys = [None if t is None else digest(look.fold(t)).hex() for t in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array([a != c for a, c in zip(raw, new)], pa.bool_()), pa.array(keys, pa.string())], ["doc_id", "text", "changed", "look"])

    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, text string, changed boolean, look string")


def looks(documents: DataFrame) -> DataFrame:
    """doc_id, look, raw: 128-bit fingerprints of the folded form and of the text itself; null texts are left out."""
    docs, letters = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null"), confusable_letters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = look_of(letters)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(look.fold(t)) for t in texts], pa.binary()), pa.array([digest(t) for t in texts], pa.binary())], ["doc_id", "look", "raw"])

    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, look binary, raw binary")


def look_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its look), n_links (documents of other strings with its look)."""
    found = cut(looks(documents))
    strings = found.groupBy("look", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    of_look = strings.groupBy("look").agg(F.sum("n").alias("n_look"), F.min("first").alias("class_id"))
    sizes = strings.join(of_look, "look").select("raw", "class_id", (F.col("n_look") - F.col("n")).alias("n_links"))
    return salted(found, sizes).select("doc_id", "class_id", "n_links")


def salted(documents: DataFrame, strings: DataFrame, by: str = "doc_id") -> DataFrame:
    """Documents joined with rows for their strings on ``raw``; the documents of a hot string are spread over SALTS tasks."""
    spread = documents.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return spread.join(strings.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["raw", "salt"]).drop("salt")


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """doc_id_a < doc_id_b: each pair of documents that look the same with different strings.

    The asked result is pairs, so its size is that of the answer (``look_classes`` is the form that grows with the
    documents only): strings of one look are paired first, then their documents are attached, so copies of one string
    are never paired with each other. Only fingerprints and ids are shuffled, never texts, and a string with very many
    copies is spread. Null texts have no look; empty texts are one string, and look like texts of invisible characters only.
    """
    found = cut(looks(documents))  # texts are read and folded once, whatever follows
    strings = found.select("look", "raw").distinct()
    pairs = strings.join(strings.withColumnRenamed("raw", "raw_b"), "look").filter("raw < raw_b").select("raw", "raw_b")
    first = salted(found.select("raw", F.col("doc_id").alias("a")), pairs, "a").select("a", F.col("raw_b").alias("raw"))
    both = salted(first, found.select("raw", F.col("doc_id").alias("b")), "a")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))
