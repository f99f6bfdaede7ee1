"""Surrogates for personal data: keyed, consistent by type, and of the same form as what they replace.

Each value is written as a number in the mixed radix of its characters (a digit stays a digit, a letter stays a letter of
its script and case; alphabets beyond the listed ones are the letters of one category in a run of 128 code points), mapped
by a keyed one-to-one map of that number's range without fixed points, and written back. The map being one-to-one, two
different values of a form never get the same surrogate, and equal values always do, in any document and on any executor,
without a shared table. A value without any letter or digit that could move gets a keyed token. Names keep their gender:
they are moved within the list of their gender by a keyed one-to-one map; names that aren't listed never become listed ones.

Persons are found by what stands around a name, not by a list of names: titles, phrases that introduce or address
somebody, a name before an address in brackets; a listed given name before any capitalised word is one more sign. A name
found in this way, and its last word alone, is then replaced wherever it stands in the same text.

surrogate_collisions() checks distinctness over a whole corpus, and distinct() replaces all with the next of a row of keys
as long as two values share a surrogate. Values of one phone number in different spellings share their surrogate digits.
What stands for a value beside its surrogate is an HMAC under the same key. Null texts stay null, empty ones empty; very
long texts are scanned in linear time; ids, ties and repeated rows have no influence; other columns are not read, or are
carried along; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import hmac
import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: First names by gender, for the persons rule.
FEMALE = ("Alice", "Amelia", "Anna", "Camille", "Carmen", "Charlotte", "Claire", "Elena", "Emma", "Eva", "Hannah", "Ines", "Isabel", "Julia", "Laura", "Lucia", "Maria", "Marie", "Olivia", "Paula", "Sarah", "Sofia", "Sophie", "Valerie")
MALE = ("Adam", "Antonio", "Carlos", "Daniel", "David", "Diego", "Felix", "Fernando", "George", "Hugo", "Jack", "James", "Javier", "John", "Jonas", "Jules", "Louis", "Lucas", "Martin", "Michael", "Paul", "Peter", "Robert", "Thomas")
SURNAMES = ("Adler", "Bauer", "Bernard", "Brown", "Clark", "Diaz", "Dubois", "Fischer", "Garcia", "Harris", "Johnson", "Keller", "Lambert", "Lewis", "Lopez", "Martinez", "Meyer", "Miller", "Moreau", "Navarro", "Petit", "Ramos", "Schmidt", "Smith", "Taylor", "Weber", "Wilson", "Young")
#: The alphabets within which a letter stays.
ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase, "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
_OF: dict[str, str | None] = {c: a for a in ALPHABETS for c in a}
#: Titles, with the gender that they tell, if any.
TITLES = dict.fromkeys(("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don"), MALE) | dict.fromkeys(("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Doña"), FEMALE) | dict.fromkeys(("Mx", "Dr", "Prof", "Professor", "Professeur", "Profesor", "Profesora", "Doctor", "Docteur"))
#: Phrases before a name; after the second group two words with a capital are needed.
NAMING = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "Name:", "Nom:", "Nombre:", "Patient:", "Customer:", "Employee:")
GREETING = ("Dear", "Liebe", "Lieber", "Cher", "Chère", "Estimado", "Estimada", "Regards,", "Sincerely,", "Signed", "Signed,", "signed by", "Contact", "Contact:", "written by", "I am", "I'm", "ich bin", "je suis", "soy")
_LISTED = frozenset(FEMALE + MALE + SURNAMES)
#: Keys that are tried before a corpus is given up.
MAX_KEYS = 8
#: What is found by form; a text is looked at if it has the sign.
PATTERNS = (
    ("email", "@", r"(?<![\w\u0300-\u036f\u0900-\u0dff.+%-])[\w\u0300-\u036f\u0900-\u0dff.+%-]+@[\w\u0300-\u036f\u0900-\u0dff-]+(?:\.[\w\u0300-\u036f\u0900-\u0dff-]+)*\.[\w\u0300-\u036f\u0900-\u0dff]{2,}"),
    ("iban", "", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", "", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"),
    ("ssn", "-", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", ".", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d)"),
    ("phone", "", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{7,15}(?!\d)|(?<![\w.])(?:\+\d{1,3}[ .-]?\d|0\d)(?:[ .-]\d{2}){4}(?!\d)"),
)
_FIND = tuple((kind, sign, re.compile(pattern)) for kind, sign, pattern in PATTERNS)
_DIGITS = re.compile(r"\d(?:\D{0,2}\d){3}")
_KINDS = (*(kind for kind, *_ in PATTERNS), "person", "again")
_ORDER = {kind: i for i, kind in enumerate(_KINDS)}
_WORD = r"(?:\p{Lu}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*|\p{Lo}[\p{Lo}\p{M}]*)"
PARTICLES = ("von", "van", "de", "del", "der", "den", "di", "da", "la", "le")
_LINK = rf" (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
#: Names after a title (its gap included), after NAMING, after GREETING and after a given name.
_AFTER = {
    "title": regex.compile(rf"\.?{_LINK}({_WORD}(?:{_LINK}{_WORD}){{0,2}})"),
    "naming": regex.compile(rf" ({_WORD}(?:{_LINK}{_WORD}){{0,2}})"),
    "greeting": regex.compile(rf"[ \n]({_WORD}(?:{_LINK}{_WORD}){{1,2}})"),
    "given": regex.compile(rf"({_LINK}{_WORD})"),
}
#: A name before an address in brackets.
_BEFORE = regex.compile(rf"(?<![\w])({_WORD}(?:{_LINK}{_WORD}){{1,2}}) [<(]$")
_SIGNS = ahocorasick.Automaton()
for _kind, _words in (("given", FEMALE + MALE), ("greeting", GREETING), ("naming", NAMING), ("title", tuple(TITLES))):
    for _x in _words:
        for _form_of in {_x, _x[0].upper() + _x[1:]}:
            _SIGNS.add_word(_form_of, (_kind, len(_form_of)))
_SIGNS.make_automaton()


def persons(text: str, emails: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of names; with their title, if any."""
    for last, (kind, n) in _SIGNS.iter(text):
        start, end = last + 1 - n, last + 1
        if start and (text[start - 1].isalnum() or text[start - 1] == "_") or end >= len(text) or text[end - 1].isalnum() and text[end].isalnum():
            continue
        if m := _AFTER[kind].match(text, end, min(len(text), end + 200)):
            yield (start, m.end()) if kind in ("title", "given") else m.span(1)
    for start, _ in emails:
        if m := _BEFORE.search(text, max(0, start - 120), start):
            yield m.span(1)


def again(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of other places of the names at the given ones: whole, and their last word alone."""
    whole, last = set(), set()
    for start, end in spans:
        words = text[start:end].split(" ")
        words = words[words[0].rstrip(".") in TITLES :]
        if words:
            whole.add(" ".join(words))
            last.add(words[-1])
    for names in (whole, last - whole):  # each by itself: a last word counts where its whole name turns out to be part of something else
        names = {n for n in names if len(n) > 1 and n not in PARTICLES}
        if names:
            for m in re.finditer(rf"(?<!\w)(?:{'|'.join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))})(?!\w)", text):
                yield m.span()


def detect(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) in code points, without overlap: the leftmost first, of those the first of PATTERNS.

    As one scan for all kinds would find them: a match that reaches into the one before is looked for again behind it.
    """
    out, at, next_, digits = [], 0, [], _DIGITS.search(text) is not None
    for kind, sign, pattern in _FIND:
        if sign in text and (digits or kind == "email") and (m := pattern.search(text)):
            next_.append((m.start(), _ORDER[kind], m.end(), pattern))
    emails = [m.span() for m in _FIND[0][2].finditer(text)] if "@" in text else []
    named = list(persons(text, emails))
    next_ += [(a, _ORDER["person"], b, None) for a, b in named]
    next_ += [(a, _ORDER["again"], b, None) for a, b in again(text, named)]
    heapq.heapify(next_)
    while next_:
        start, order, end, pattern = heapq.heappop(next_)
        if start >= at:
            out.append(("person" if _KINDS[order] == "again" else _KINDS[order], start, end))
            at = end
        if pattern and (m := pattern.search(text, at)):
            heapq.heappush(next_, (m.start(), order, m.end(), pattern))
    return out


def alphabet(c: str) -> str | None:
    """The characters within which c stays: a listed alphabet, else those of its category among 128 neighbours; none for other signs."""
    if c not in _OF:
        kind = unicodedata.category(c)
        first = ord(c) & ~0x7F
        same = "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind and x not in _LISTED_LETTERS) if kind[0] == "L" or kind == "Nd" else ""
        _OF[c] = same if len(same) > 1 else None
    return _OF[c]


_LISTED_LETTERS = frozenset("".join(ALPHABETS))


class Surrogates:
    """Keyed one-to-one maps; two objects with the same key agree."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(maxsize=100_000)(self._of)

    def digest(self, kind: str, value: str) -> str:
        """What tells a value apart without telling it to those who don't have the key."""
        return hmac.new(self.key, f"value:{kind}:{canonical(kind, value)}".encode(), hashlib.sha256).hexdigest()

    def _round(self, tweak: str, i: int, x: int, bits: int) -> int:
        out = hmac.new(self.key, f"{tweak}:{i}:{x}".encode(), hashlib.sha256).digest()
        while len(out) * 8 < bits:
            out += hashlib.sha256(out).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _permute(self, x: int, n: int, tweak: str, back: bool = False) -> int:
        """A keyed permutation of range(n): a balanced Feistel network, walked until it lands within."""
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        while True:
            left, right = x >> half, x & low
            for i in reversed(range(8)) if back else range(8):
                if back:
                    left, right = right ^ self._round(tweak, i, left, half), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, half)
            x = left << half | right
            if x < n:
                return x

    def moved(self, x: int, n: int, tweak: str) -> int:
        """One-to-one on range(n), and never x itself if n > 1."""
        return self._permute((self._permute(x, n, tweak) + 1) % n, n, tweak, back=True)

    def _form(self, text: str, tweak: str) -> str:
        """Characters of an alphabet change within it, all others stay: texts with the same alphabets at the same places are permuted."""
        radix = [(i, a) for i, c in enumerate(text) if (a := alphabet(c))]
        n = x = 0
        size = 1
        for i, a in radix:
            x, size = x * len(a) + a.index(text[i]), size * len(a)
        if size < 2:
            return f"{tweak}-{self.digest(tweak, text)[:16]}"
        x, out = self.moved(x, size, f"{tweak}|{''.join('.' if alphabet(c) else c for c in text)}"), list(text)
        for i, a in reversed(radix):
            x, n = divmod(x, len(a))
            out[i] = a[n]
        return "".join(out)

    def _of(self, kind: str, value: str) -> str:
        if kind == "email":
            local, _, domain = value.rpartition("@")
            name, dot, top = domain.rpartition(".")
            return f"{self._form(local + '@' + name, kind)}{dot}{top}"
        if kind == "ip":
            x = 0
            for part in value.split("."):
                x = x * 256 + int(part)
            x = self.moved(x, 256**4, kind)
            return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        if kind == "phone":
            digits = re.sub(r"\D", "", value)
            n = min(10, len(digits))
            new = iter(digits[:-n] + str(self.moved(int(digits[-n:]), 10**n, f"{kind}{n}")).zfill(n))
            return re.sub(r"\d", lambda _: next(new), value)
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            off = (int(digits[-1]) - int(check_digit(digits[:-1]))) % 10  # 0: the last digit is the right one
            body = self._form(digits[:-1], f"{kind}{off == 0}")
            off = off and self.moved(off - 1, 9, f"{kind}:{body}") + 1
            new = iter(body + str((int(check_digit(body)) + off) % 10))
            return re.sub(r"\d", lambda _: next(new), value)
        if kind == "person":
            parts = value.split(" ")
            for i in range(int(parts[0].rstrip(".") in TITLES), len(parts)):
                if parts[i] in FEMALE or parts[i] in MALE:
                    own = FEMALE if parts[i] in FEMALE else MALE
                    parts[i] = own[self.moved(own.index(parts[i]), len(own), "given")]
                elif parts[i] in PARTICLES:
                    continue
                elif parts[i] in SURNAMES:
                    parts[i] = SURNAMES[self.moved(SURNAMES.index(parts[i]), len(SURNAMES), "surname")]
                else:
                    # Walked on past listed names. The map is one cycle, so the other names stay one-to-one. The same
                    # name moves alike under any title, so that it is still known to be the same.
                    parts[i] = self._form(parts[i], "name")
                    while parts[i] in _LISTED:
                        parts[i] = self._form(parts[i], "name")
            return " ".join(parts)
        return self._form(value, kind)

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (type, value, surrogate) of each entity in it."""
        out, at, found = [], 0, []
        for kind, start, end in detect(text):
            new = self.of(kind, text[start:end])
            found.append((kind, text[start:end], new))
            out += [text[at:start], new]
            at = end
        return "".join(out) + text[at:], found


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def check_digit(body: str) -> str:
    return next(d for d in string.digits if luhn(body + d))


ENTITIES = "array<struct<type: string, value_hmac: string, surrogate: string>>"


def replace_pii(docs: DataFrame, key: bytes = b"presswork", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_entities, entities (array of type, value digest, surrogate): one row for each row of docs. Maps rows; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        one = pa.struct([("type", pa.string()), ("value_hmac", pa.string()), ("surrogate", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                done = [(None, []) if t is None else keyed.rewrite(t) for t in part.column(1).to_pylist()]
                told = [[{"type": k, "value_hmac": keyed.digest(k, v), "surrogate": s} for k, v, s in found] for _, found in done]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array(told, pa.list_(one))], ["doc_id", "text", "n_entities", "entities"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, n_entities long, entities {ENTITIES}")


def free_name(docs: DataFrame, name: str = "_entities") -> str:
    """The name, with underscores before it until no column of docs has it."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name = "_" + name
    return name


def rewrite_texts(docs: DataFrame, key: bytes = b"presswork", text_col: str = "text") -> DataFrame:
    """docs with all columns, the text with surrogates, and the column free_name(docs) as entities in replace_pii. Maps rows; nothing is shuffled."""
    at, told_in = docs.columns.index(text_col), free_name(docs)
    one = pa.struct([("type", pa.string()), ("value_hmac", pa.string()), ("surrogate", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(key)
        for batch in batches:
            done = [(None, []) if t is None else keyed.rewrite(t) for t in batch.column(at).to_pylist()]
            told = [[{"type": k, "value_hmac": keyed.digest(k, v), "surrogate": s} for k, v, s in found] for _, found in done]
            out = batch.set_column(at, batch.schema.field(at).name, pa.array([t for t, _ in done], batch.column(at).type))
            yield out.append_column(told_in, pa.array(told, pa.list_(one)))

    return docs.mapInArrow(run, docs.withColumn(told_in, F.lit(None).cast(ENTITIES)).schema)


def distinct(replaced: Callable[[bytes], DataFrame], key: bytes, entities: str = "entities") -> DataFrame:
    """replaced(key), written, if no two values share a surrogate in it; else replaced() with the next key for the whole corpus.

    Key i is the HMAC of "key i" under the given key. After MAX_KEYS keys with collisions it raises.
    """
    for i in range(MAX_KEYS):
        out = written(replaced(key if i == 0 else hmac.new(key, f"key {i}".encode(), hashlib.sha256).digest()))
        if surrogate_collisions(out.select(F.col(entities).alias("entities"))).isEmpty():
            return out
    raise ValueError(f"surrogates of different values are equal under each of {MAX_KEYS} keys")


def canonical(kind: str, value: str) -> str:
    """What counts as the same value."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return re.sub(r"\D", "", value)[-10:] if kind == "phone" else value


def surrogate_collisions(replaced: DataFrame) -> DataFrame:
    """type, surrogate, n_values of surrogates that stand for more than one value; empty if all is well."""
    each = replaced.select(F.explode("entities").alias("e")).select("e.type", "e.surrogate", "e.value_hmac").distinct()
    same = F.when(F.col("type") == "phone", F.right(F.regexp_replace("surrogate", r"\D", ""), F.lit(10))).otherwise(F.col("surrogate"))
    return each.withColumn("surrogate", same).distinct().groupBy("type", "surrogate").agg(F.count("*").alias("n_values")).filter("n_values > 1")
