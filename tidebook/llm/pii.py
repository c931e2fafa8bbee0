"""Personal data: detected entities are replaced by keyed surrogates of the same kind.

An entity is what its type takes as its identity: an address without regard to
case, a number without its punctuation. A keyed permutation of all strings with
the same format gives its surrogate, so the same entity has the same surrogate in
every document (coreference) and different entities have different ones
(distinctness). Digits stay digits, hexadecimal stays hexadecimal, letters stay in
their script, case and class of vowels or consonants (or, in other scripts, in
their category and block of Unicode); card numbers keep their checksum's validity.
A given name of the lists below becomes another one of the same gender, other names
keep a gendered ending; title, punctuation and spacing are those found. A name is replaced word by word, so a
surname alone and in full agree, as do the words of an address before its @; a domain's labels are replaced as well, all
but the last and a general one before it, the same domain always by the same.

What a permutation cannot promise is checked over all entities of the corpus: a
surrogate that is its own entity, another entity's surrogate or an entity that
occurs somewhere is drawn again, until no such case is left. Where a format has too
few strings, later draws are one character longer, so there always is one.

Names are those after a title or a phrase that introduces one, and a given name of the lists, in capitals or
not, with what follows it; a name with neither is not found.

Defined cases: null stays null and has no entities; repeated rows get equal texts;
digits of any script are digits, and a surrogate has those of the mention's script;
an empty table gives no rows; `anonymize` keeps every column, whatever its name.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .tables import materialize

#: The session's setting that holds the key.
KEY_SETTING = "spark.tidebook.surrogateKey"
#: Redrawn surrogates sent to all executors; if there are more, they are joined instead.
SENT = 100_000
#: After so many draws a surrogate gets one character more.
DRAWS = 8

DIGITS, HEX = "0123456789", "0123456789abcdef"
#: Letters that may stand for one another: vowels and consonants of each script.
LETTERS = [
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áéíóú",
    "àèìòù",
    "âêîôû",
    "äöü",
    "аеиоуыэюя",
    "бвгджзклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
]
#: Words before a name; those of women are in the second list.
TITLES_M = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа"]
TITLES = TITLES_M + TITLES_F + ["Dr", "Prof"]
#: Given names, by gender and script; one becomes another of its list.
GIVEN = [
    "Anna Maria Laura Julia Sarah Emma Sophie Claudia Helena Martina Charlotte Isabel Carmen Lucia Elena Camille Chantal Monique Sabine Ingrid Heike Emily Jessica Karen Nancy Susan Linda Patricia Elizabeth Barbara".split(),
    "John Peter Thomas Michael David James Robert William Richard Joseph Hans Jürgen Stefan Andreas Wolfgang Klaus Pierre Jacques François Michel Philippe Carlos Miguel Antonio Javier Pedro Daniel Martin Paul George".split(),
    "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    "Иван Пётр Сергей Андрей Дмитрий Алексей Николай Владимир".split(),
]
#: Phrases that a name follows.
CUES = ["my name is", "My name is", "ask for", "Best regards,", "Kind regards,", "Sincerely,", "mein Name ist", "Mein Name ist", "Mit freundlichen Grüßen", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут"]
GIVEN_OF = {name.lower(): names for names in ([n.lower() for n in g] for g in GIVEN) for name in names}

_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
_SECRET = r"(?i:password|passwd|token|secret|api[_-]?key)\s*[=:]"
PATTERNS = {
    "email": r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})",
    "key": r"(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)",
    "secret": rf"(?:{_SECRET}\s*[\"']?)(?P<secret>[A-Za-z0-9+/_-]{{8,}})",
    "iban": r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
    "ip": r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
    "phone": r"(?P<phone>(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.-])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?![\d-]))",
    "ssn": r"(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))",
    "card": r"(?P<card>(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d))",
    "name": rf"\b(?:(?:{'|'.join(TITLES)})\.?\s+|(?:{'|'.join(map(re.escape, CUES))})\s+(?={_NAME}[ -]{_NAME})|(?=(?:{'|'.join(f for g in GIVEN for n in g for f in (n, n.upper()))})[ -]{_NAME}))(?P<name>{_NAME}(?:[ -]{_NAME}){{0,2}})",
}
ANY = re.compile("|".join(PATTERNS.values()))


#: What every match has: a digit of any script or @ (email and all numbers), or one of these words (key, name).
SIGN, WORDS = re.compile(r"[\d@]"), ("AKIA", "ASIA", *TITLES, *CUES, *(f for g in GIVEN for n in g for f in (n, n.upper())))
SECRET = re.compile(_SECRET)


def may_have(text: str) -> bool:
    """False only if no pattern matches: a cheap test derived from each of them."""
    return bool(SIGN.search(text)) or any(w in text for w in WORDS) or ((":" in text or "=" in text) and bool(SECRET.search(text)))


def detect(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities, from left to right; none overlap."""
    if not may_have(text):
        return []
    return [(m.lastgroup, m.start(m.lastgroup), m.end(m.lastgroup)) for m in ANY.finditer(text)]


def _ascii(text: str) -> str:
    """Decimal digits of any script as those of ASCII."""
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def _like(old: str, new: str) -> str:
    """The digits of new in the script of the digit old."""
    zero = ord(old) - int(old)
    return "".join(chr(zero + int(c)) for c in new)


def identity(kind: str, found: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("phone", "ssn", "card"):
        return _ascii(re.sub(r"\D", "", found))
    if kind == "iban":
        return _ascii(found.replace(" ", ""))
    if kind in ("email", "name"):
        # Letter by letter, and a letter whose lower case is longer stays, so that each place keeps its letter.
        return "".join(low if len(low := c.lower()) == 1 else c for c in found)
    return _ascii(found) if kind == "ip" else found


def _number(key: bytes, what: str, n: int) -> int:
    """A keyed number below n."""
    return int.from_bytes(hmac.new(key, what.encode(), hashlib.sha256).digest() * (1 + n.bit_length() // 224), "big") % n


def permute(text: str, alphabets: list[str | None], key: bytes, tweak: str) -> str:
    """A permutation of all strings that have, at each place, a letter of that place's alphabet (None: kept as it is).

    The places' letters form one number in mixed radix, split in two; each half is shifted in turn by a keyed
    function of the other, which can be undone step by step, so different strings stay different.
    """
    at = [i for i, a in enumerate(alphabets) if a]
    if not at:
        return text
    halves = [at[::2], at[1::2]]
    sizes = [1, 1]
    value = [0, 0]
    for k in (0, 1):
        for i in halves[k]:
            value[k] = value[k] * len(alphabets[i]) + alphabets[i].index(text[i])
            sizes[k] *= len(alphabets[i])
    fixed = "".join(c if not a else f"<{len(a)}>" for c, a in zip(text, alphabets, strict=True))
    for turn in range(6):
        k = turn % 2
        value[k] = (value[k] + _number(key, f"{tweak}|{turn}|{fixed}|{value[1 - k]}", sizes[k])) % sizes[k]
    out = list(text)
    for k in (0, 1):
        for i in reversed(halves[k]):
            value[k], d = divmod(value[k], len(alphabets[i]))
            out[i] = alphabets[i][d]
    return "".join(out)


def _stable(c: str) -> bool:
    """Whether upper and then lower case give the letter back."""
    return c.upper().lower() == c


@lru_cache(maxsize=4_000)
def _alphabets(block: int) -> dict[str, str]:
    """The alphabet of each letter of a block of 256: its script's letters of its category there that are no capitals."""
    classes: dict[tuple, list[str]] = {}
    for c in map(chr, range(block << 8, (block + 1) << 8)):
        if c.isalnum() and not c.isdecimal() and c.lower() == c and not any(c in a for a in LETTERS):
            classes.setdefault((unicodedata.category(c), unicodedata.name(c, "").split(" ")[0], _stable(c)), []).append(c)
    return {c: "".join(own) for own in classes.values() if len(own) > 1 for c in own}


def alphabet(c: str) -> str | None:
    """The letters that may stand for c; None if it is alone. They all have this alphabet, so a permutation can be undone."""
    return next((a for a in LETTERS if c in a), None) or (None if c.isascii() else _alphabets(ord(c) >> 8).get(c))


def _letters(text: str) -> list[str | None]:
    return [DIGITS if c in DIGITS else alphabet(c) for c in text]


@lru_cache(maxsize=1_000)
def _given(names: tuple[str, ...], key: bytes, tweak: str) -> dict[str, str]:
    """A keyed permutation of a list of given names."""
    order = sorted(names, key=lambda n: hmac.new(key, f"{tweak}|{n}".encode(), hashlib.sha256).digest())
    return dict(zip(names, order, strict=True))


WORD = re.compile(r"[^ -]+")
#: The words of an address before its @.
LOCAL = re.compile(r"[^._%+-]+")
#: Labels of a domain that stand for a kind of owner, before a country's.
GENERAL = ("co", "com", "org", "net", "ac", "gov", "edu", "gob", "gouv")


def units(kind: str, who: str) -> list[str]:
    """What of an entity is drawn for by itself: the words of a name that are no listed given names, or else all of it."""
    own = [w for w in WORD.findall(who) if w not in GIVEN_OF] if kind == "name" else []
    return list(dict.fromkeys(own)) or [who]


def _person(who: str, key: bytes, tweak: str) -> str:
    """Given names of the lists from their list; the letters of other words permuted, but for the last one if it tells the gender."""
    return WORD.sub(lambda m: _given(tuple(GIVEN_OF[m.group()]), key, tweak)[m.group()] if m.group() in GIVEN_OF else _word(m.group(), key, tweak), who)


def _word(word: str, key: bytes, tweak: str) -> str:
    kept = {len(word) - 1} if word[-1] in "ao" and len(word) > 1 else set()
    return permute(word, [None if i in kept else a for i, a in enumerate(_letters(word))], key, tweak)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10


def surrogate(kind: str, who: str, key: bytes, attempt: int = 0) -> str:
    """The identity that stands for `who`. Draws after the first DRAWS have more characters, as its format may be used up."""
    new, more = _surrogate(kind, who, key, attempt), attempt // DRAWS
    if not more:
        return new
    if kind == "ip":
        return new + "".join(f".{_number(key, f'{attempt}|{i}|{who}', 256)}" for i in range(more))
    own = next((a for c in reversed(who) if kind == "name" and (a := alphabet(c))), LETTERS[0])
    letters = DIGITS if kind in ("phone", "ssn", "card", "iban") else own
    extra = "".join(letters[_number(key, f"{kind}|{attempt}|{i}|{who}", len(letters))] for i in range(more))
    return extra + new if kind in ("email", "name") else new + extra


def _surrogate(kind: str, who: str, key: bytes, attempt: int) -> str:
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = who.rpartition("@")
        labels = domain.split(".")
        kept = 2 if len(labels) > 2 and labels[-2] in GENERAL else 1
        own = [permute(x, _letters(x), key, "domain") for x in labels[:-kept]]
        # As the words of names, at first; a later draw permutes the address as a whole.
        new = permute(local, _letters(local), key, tweak) if attempt else LOCAL.sub(lambda m: _person(m.group(), key, "name|0"), local)
        return new + "@" + ".".join([*own, *labels[-kept:]])
    if kind == "ip":
        bits = "".join(f"{int(x):08b}" for x in who.split("."))
        new = permute(bits, ["01"] * 32, key, tweak)
        return ".".join(str(int(new[i : i + 8], 2)) for i in range(0, 32, 8))
    if kind == "phone":
        lead = len(who) - 10 if len(who) > 10 else 0
        first = "23456789" if who[lead] in "23456789" else "01"
        return permute(who, [None] * lead + [first] + [DIGITS] * (len(who) - lead - 1), key, tweak)
    if kind == "card":
        middle = permute(who[1:-1], [DIGITS] * (len(who) - 2), key, tweak)
        return next(x for d in DIGITS if luhn(x := who[0] + middle + d) == luhn(who))
    if kind == "name":
        return _person(who, key, tweak)
    if kind == "secret" and set(who) <= set(HEX):
        return permute(who, [HEX] * len(who), key, tweak)
    if kind == "iban":
        return permute(who, [None, None] + [DIGITS if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else None for c in who[2:]], key, tweak)
    kept = 4 if kind == "key" else 0
    return permute(who, [None] * kept + [DIGITS if c in DIGITS else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else None for c in who[kept:]], key, tweak)


def _cased(found: str, new: str) -> str:
    """new in the case of found: letter by letter from the right, a longer front as one that starts a word."""
    more = max(len(new) - len(found), 0)
    like = found[len(found) - (len(new) - more) :] if len(new) < len(found) else found
    out = [n.upper() if c.isupper() and len(n.upper()) == 1 and _stable(n) else n for c, n in zip(like, new[more:], strict=True)]
    if more and found[:1].isupper() and not found[1:2].isupper():
        out[0] = new[more]
        return new[:more].capitalize() + "".join(out)
    return (new[:more].upper() if found[:2].isupper() else new[:more]) + "".join(out)


def dress(kind: str, found: str, new: str) -> str:
    """A surrogate identity with the case, spacing and punctuation of the mention that it replaces."""
    if kind in ("phone", "ssn", "card", "iban"):
        rest = iter(new)
        return "".join((_like(c, next(rest)) if c.isdecimal() else next(rest)) if c.isalnum() else c for c in found) + "".join(rest)
    if kind == "ip" and not found.isascii():
        parts, own = new.split("."), [o[0] for o in found.split(".")]
        return ".".join(_like(own[min(i, 3)], n) for i, n in enumerate(parts))
    if kind == "email":
        return _cased(found, new)
    if kind == "name":
        # Words stand for words, in order, with what is between them as found.
        words = iter(WORD.findall(new))
        return WORD.sub(lambda m: _title(m.group(), next(words)), found)
    return new


def _title(found: str, new: str) -> str:
    if len(found) == len(new):
        return _cased(found, new)
    fits = len(new.upper()) == len(new) and all(map(_stable, new))
    if fits and len(found) > 1 and found.isupper():
        return new.upper()
    first = new[0].upper() if found[0].isupper() and len(new[0].upper()) == 1 and _stable(new[0]) else new[0]
    return first + new[1:]


def stands_for(kind: str, who: str, again: dict[tuple[str, str], int], key: bytes) -> str:
    """The surrogate identity, of the draws that `again` has for its units."""
    if units(kind, who) == [who]:
        return surrogate(kind, who, key, again.get((kind, who), 0))
    return WORD.sub(lambda m: _person(m.group(), key, "name|0") if m.group() in GIVEN_OF else surrogate(kind, m.group(), key, again.get((kind, m.group()), 0)), who)


def replace(text: str, again: dict[tuple[str, str], int], key: bytes) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with surrogates, and (type, start, length, surrogate) in the new text."""
    out, spans, last, size = [], [], 0, 0
    for kind, a, b in detect(text):
        new = dress(kind, text[a:b], stands_for(kind, identity(kind, text[a:b]), again, key))
        out += [text[last:a], new]
        size += a - last
        spans.append((kind, size, len(new), new))
        size, last = size + len(new), b
    return "".join([*out, text[last:]]), spans


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING. Where the session has none, one is drawn at random for it, so nobody can undo its
    surrogates and those of another session differ; to get the same ones in several sessions, set it."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def _id(doc_id: str, text: str) -> Column:
    """What a document's entities are found by again: its doc_id, or where that is null a hash of the text.

    Texts that share one get each other's attempts as well, which are the same for an entity wherever it occurs.
    """
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))


def entities(documents: DataFrame) -> DataFrame:
    """doc_id (or what stands for it), kind, who: each unit of an entity once a document."""

    def run(batches):
        for part in W.chunks(batches):
            rows = sorted({(doc, kind, who) for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True) if text for kind, a, b in detect(text) for who in units(kind, identity(kind, text[a:b]))}, key=str)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["doc_id", "kind", "who"])

    return documents.select(_id("doc_id", "text").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, who string")


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """kind, who, attempt with new: the surrogate of that attempt."""

    def run(batches):
        for b in batches:
            new = [surrogate(k, w, key, a) for k, w, a in zip(*(b[c].to_pylist() for c in ("kind", "who", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("kind", "who", "attempt")), pa.array(new, pa.string())], names=["kind", "who", "attempt", "new"])

    return rows.select("kind", "who", F.col("attempt").cast("int").alias("attempt")).mapInArrow(run, "kind string, who string, attempt int, new string")


def redrawn(found: DataFrame, key: bytes) -> DataFrame | None:
    """kind, who, attempt of the entities whose first surrogate will not do; None if all do.

    A surrogate may not be an entity of the corpus, a listed given name (unless it stands for one) nor the surrogate of another; of several entities with one
    surrogate the first keeps it. Rounds go on until none is left; each draws only for those left by the one before,
    and each DRAWS rounds their surrogates are a character longer, so there are more of them than entities.
    """
    every = materialize(found.select("kind", "who").distinct(), "all")
    listed = F.array(*(F.lit(n) for n in sorted(GIVEN_OF)))
    real = every.select("kind", F.col("who").alias("new"))
    drawn = materialize(_drawn(every.withColumn("attempt", F.lit(0)), key), "drawn")
    settled: DataFrame | None = None
    while True:
        first = drawn.groupBy("kind", "new").agg(F.min("who").alias("who"))
        good = first.join(real, ["kind", "new"], "left_anti").where((F.col("kind") != "name") | F.array_contains(listed, F.col("who")) | ~F.array_contains(listed, F.col("new")))
        if settled is not None:
            good = good.join(settled, ["kind", "new"], "left_anti")
        good = materialize(drawn.join(good, ["kind", "new", "who"]).select("kind", "who", "attempt", "new"), "settled")
        left = materialize(drawn.join(good, ["kind", "who"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "left")
        settled = good if settled is None else settled.unionAll(good)
        if left.isEmpty():
            break
        drawn = materialize(_drawn(left, key), "drawn")
    changed = settled.where("attempt > 0").select("kind", "who", "attempt")
    return None if changed.isEmpty() else changed


AGAIN = "array<struct<kind: string, who: string, attempt: int>>"
SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("length", "integer").add("surrogate", "string"))


def rewritten(documents: DataFrame, key: bytes) -> DataFrame:
    """row: all columns of documents as they are; text: the rewritten one; entities: SPANS in it."""
    found = materialize(entities(documents), "entities")
    changed = redrawn(found, key)
    out = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    if changed is None:
        out = out.withColumn("again", F.lit(None).cast(AGAIN))
    else:
        each = found.join(changed, ["kind", "who"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "who", "attempt")).alias("again"))
        each = materialize(each.withColumnRenamed("doc_id", "id"), "again")
        few = (each.agg(F.sum(F.size("again"))).first()[0] or 0) <= SENT
        out = out.join(F.broadcast(each) if few else each, _id("row.doc_id", "row.text") == F.col("id"), "left").drop("id")

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            texts = row.field([f.name for f in row.type].index("text")).to_pylist()
            done = [(None, []) if t is None else replace(t, {(x["kind"], x["who"]): x["attempt"] for x in a or ()}, key) for t, a in zip(texts, batch.column("again").to_pylist(), strict=True)]
            spans = [[dict(zip(("kind", "start", "length", "surrogate"), s, strict=True)) for s in d[1]] for d in done]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))
            yield pa.RecordBatch.from_arrays([row, pa.array([d[0] for d in done], pa.string()), pa.array(spans, kind)], names=["row", "text", "entities"])

    return out.mapInArrow(run, T.StructType([out.schema["row"]]).add("text", "string").add("entities", SPANS))


def anonymize(documents: DataFrame, key: bytes) -> DataFrame:
    """documents with rewritten texts, all columns in their order; n_chars, if there, is that of the new text."""
    out = rewritten(documents, key)
    columns = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*((columns[c] if c in columns else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))
