"""Surrogates for personal data: every detected entity gets a keyed replacement of its own type, script and format.

A surrogate depends on the key, the entity's kind and canonical form and an attempt number alone, so an entity has the same
one in every document (coreference), whatever the mention's punctuation or case. A given name is one entity under all its
titles: of the gender that they name, or of neither if they name both or none. The distinct entities are checked for
collisions: where two share a surrogate, or one equals a real entity, all but one move to their next attempt, until
replacements are as distinct as what they replace. So that this ends, the space of replacements of every kind grows with the
attempt; only IP addresses stay within their 254^4 and 2^128.

Detected: secrets after a key word, e-mail addresses, IPv4, IPv6 of four groups or more, IBANs (checksum), card numbers (Luhn), phone
numbers with a leading +, an area code in parentheses or in three parts of 3, 3 and 4 digits (555-123-4567, 555.123.4567), SSNs
with hyphens, and names after a listed title or from the listed given names. Not detected: other phone formats (030
1234567), shorter IPv6, and all other names.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import packed, python_ready, stored, unpacked

KEY = b"surrogates"
#: Entities with another attempt than 0 that may be sent to every task; beyond it they are joined by document.
SENT_ROWS = 100_000

# Titles by gender, and given names by script and gender.
TITLES = {"m": ("Mr", "Herr", "M", "Sr", "Señor", "Monsieur", "Sir", "г-н"), "f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Sra", "Señora", "г-жа"), "n": ("Dr", "Prof", "Mx")}
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "David", "Thomas", "Daniel", "Paul", "Mark", "George", "Peter", "Karl", "Hans", "Pierre", "Jean", "Luis", "Carlos", "Miguel", "Antonio", "Lucas"),
    ("latin", "f"): ("Mary", "Anna", "Linda", "Susan", "Sarah", "Karen", "Laura", "Julia", "Emma", "Alice", "Marie", "Sophie", "Claire", "Ingrid", "Petra", "Carmen", "Lucia", "Elena", "Isabel", "Nora"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Алексей", "Сергей", "Николай", "Михаил", "Андрей", "Павел"),
    ("cyrillic", "f"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Вера"),
}
SYLLABLES = {
    "latin": ("ba", "den", "for", "gal", "har", "kin", "lan", "mor", "nel", "pas", "ren", "sol", "tam", "ver", "wick", "zan"),
    "cyrillic": ("ба", "вол", "гор", "дем", "жар", "зим", "ков", "лаз", "мор", "нов", "пет", "рад", "сол", "тар", "хар", "чер"),
}
#: Ends of made-up given names by script and gender.
ENDINGS = {
    ("latin", "m"): ("o", "an", "us", "ric", "en", "el"),
    ("latin", "f"): ("a", "ina", "elle", "ia", "ette", "is"),
    ("cyrillic", "m"): ("ан", "ей", "ил", "ор", "ий", "ем"),
    ("cyrillic", "f"): ("а", "ия", "ина", "ья", "ета", "она"),
}
#: Attempts in which numbers keep their length; later ones have more digits, as no other of that length may be free.
LONG = 16
#: What replaces secrets of symbols alone.
SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789"
GENDER_OF = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}

TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
CAPITAL = r"[A-ZÀ-ÖØ-ÞЀ-Я][\w'’-]*[^\W\d_]"
PATTERNS = (
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\s?[=:]\s?[\"']?([^\s\"']{6,})")),
    ("email", re.compile(r"(?<![\w.+-])([\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")),
    ("ip", re.compile(r"(?<![\w.])((?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4})(?![\w:]|\.\d)")),
    ("iban", re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)")),
    ("card", re.compile(r"(?<!\w)(?<!\d[.-])(\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{4})(?!\w)|(?<![\w.+-])(?P<parts>\d{3}(?P<dot>[.-])\d{3}(?P=dot)\d{4})(?![\w-]|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
)
TITLED = re.compile(rf"(?<!\w)({TITLE})\.? ({CAPITAL}(?: {CAPITAL}){{0,2}})")
KNOWN = re.compile(rf"(?<!\w)({'|'.join(sorted(GENDER_OF, key=len, reverse=True))}) ({CAPITAL})")
DIGIT = re.compile(r"\d")
#: One of these is in every text, case-folded, that holds a secret.
SECRET_WORDS = ("token", "passw", "secret", "api")


def starts_of_names() -> ahocorasick.Automaton:
    """Finds all places where TITLED or KNOWN may match: the value is the word's length and the pattern."""
    found: dict[str, list] = {}
    for pattern, words, ends in ((TITLED, {t for ts in TITLES.values() for t in ts}, (" ", ". ")), (KNOWN, GENDER_OF, (" ",))):
        for word in words:
            for end in ends:
                found.setdefault(word + end, []).append(pattern)
    out = ahocorasick.Automaton()
    for word, patterns in found.items():
        out.add_word(word, (len(word), patterns))
    out.make_automaton()
    return out


NAMES = starts_of_names()


def luhn(digits: str) -> int:
    """The sum that a valid card number has at 0."""
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(digits))) % 10


def iban_sum(iban: str) -> int:
    """What a valid IBAN, without spaces, has at 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def exploded(address: str) -> str | None:
    """All 32 digits of an IPv6 address, in lower case; None if it is none, or has fewer than four groups."""
    try:
        found = ipaddress.IPv6Address(address).exploded
    except ValueError:
        return None
    return found if sum(map(bool, address.split(":"))) >= 4 else None


def script_of(word: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in word) else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """start, end, kind and canonical form of each entity; they don't overlap. Names are found after titles or as known
    given names before a capitalised word; each of their words is an entity, a given name with its gender. Of kinds that
    overlap the one named first stays. A pattern runs only over texts that hold what it can't do without."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def add(start: int, end: int, kind: str, canon: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, canon))

    folded = text.casefold()
    numbers = DIGIT.search(text) is not None
    may_hold = {"secret": any(w in folded for w in SECRET_WORDS), "email": "@" in text}
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text) if may_hold.get(kind, numbers) else ():
            value, place = m.group(1), m.span(1)
            if value is None:
                value, place = m.group("parts"), m.span("parts")
            if kind in ("card", "phone", "ssn"):
                canon = re.sub(r"\D", "", value)
            elif kind == "ipv6":
                canon = exploded(value)
            elif kind == "iban":
                canon = value.replace(" ", "")
            else:
                canon = value.lower() if kind == "email" else value
            if kind == "card" and luhn(canon) or kind == "ip" and any(int(x) > 255 for x in value.split(".")):
                continue
            if canon is None or kind == "iban" and (len(canon) > 34 or iban_sum(canon) != 1):
                continue
            add(*place, kind, canon)
    places: dict[re.Pattern, set[int]] = {TITLED: set(), KNOWN: set()}
    for end, (length, patterns) in NAMES.iter(text):
        for pattern in patterns:
            places[pattern].add(end + 1 - length)
    for pattern, starts in places.items():
        done = 0
        for start in sorted(starts):
            m = pattern.match(text, start) if start >= done else None
            if m is None:
                continue
            done = m.end()
            if pattern is KNOWN:
                gender, at, words = GENDER_OF[m.group(1)][1], m.start(1), [m.group(1), m.group(2)]
            else:
                gender, at, words = next(g for g, ts in TITLES.items() if m.group(1) in ts), m.start(2), m.group(2).split(" ")
            for k, word in enumerate(words):
                given = k < len(words) - 1
                kind = f"given:{GENDER_OF.get(word, ('', gender))[1]}:{script_of(word)}" if given else f"family:{script_of(word)}"
                add(at, at + len(word), kind, unicodedata.normalize("NFC", word).casefold())
                at += len(word) + 1
    return sorted(found)


class Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.key, self.seed, self.block, self.at = key, f"{kind}\0{canon}\0{attempt}".encode("utf-8", "surrogatepass"), b"", 0
        self.count = 0

    def below(self, n: int) -> int:
        if self.at + 4 > len(self.block):
            self.block, self.at = hmac.new(self.key, self.seed + self.count.to_bytes(4, "big"), hashlib.sha256).digest(), 0
            self.count += 1
        self.at += 4
        return int.from_bytes(self.block[self.at - 4 : self.at], "big") % n


def scrambled(value: str, stream: Stream) -> str:
    """Letters become letters of the same case, digits digits; lower-case hexadecimal strings stay so; the rest stays."""
    hexa = len(value) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    out = []
    for c in value:
        if hexa:
            digit = "0123456789abcdef"[stream.below(16)]
            out.append(digit.upper() if value.upper() == value else digit)
        elif c.isdigit():
            out.append(str(stream.below(10)))
        elif c.isalpha():
            base = ("а", 32) if script_of(c) == "cyrillic" else ("a", 26)
            letter = chr(ord(base[0]) + stream.below(base[1]))
            out.append(letter.upper() if c.isupper() else letter)
        else:
            out.append(c)
    return "".join(out)


@functools.lru_cache(maxsize=50_000)
def surrogate(kind: str, canon: str, attempt: int, key: bytes = KEY) -> str:
    """The canonical form of an entity's replacement."""
    stream = Stream(key, kind, canon, attempt)
    if kind == "email":
        local, domain = canon.split("@")
        name, top = domain.rsplit(".", 1)
        local, name = scrambled(local, stream), scrambled(name, stream)
        return f"{local}{''.join(SIGNS[stream.below(len(SIGNS))] for _ in range(attempt - 2))}@{name}.{top}"
    if kind == "ip":
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "ipv6":
        return ":".join("".join("0123456789abcdef"[stream.below(16)] for _ in range(4)) for _ in range(8))
    if kind == "iban":
        account = "".join(scrambled(c, stream) for c in canon[4:]) + "".join(str(stream.below(10)) for _ in range(attempt - LONG))
        return f"{canon[:2]}{98 - iban_sum(canon[:2] + '00' + account):02d}{account}"
    if kind == "card":
        digits = canon[0] + "".join(str(stream.below(10)) for _ in range(len(canon) - 2 + max(0, attempt - LONG)))
        return digits + str(next(d for d in range(10) if luhn(f"{digits}{d}") == 0))
    if kind == "phone":
        lead = max(0, len(canon) - 10)  # the country's code
        return canon[:lead] + "".join(str(stream.below(10)) for _ in range(len(canon) - lead + max(0, attempt - LONG)))
    if kind.startswith("given"):
        _, gender, script = kind.split(":")
        of = lambda table: table[(script, gender)] if gender in "mf" else table[(script, "m")] + table[(script, "f")]
        if not attempt:
            return of(GIVEN)[stream.below(len(of(GIVEN)))].casefold()
        # where that is a real name of the corpus, or another's, a name is made up of one word: longer from time to time, so
        # that there are always more
        parts = SYLLABLES[script]
        stem = "".join(parts[stream.below(len(parts))] for _ in range(2 + (attempt - 1) // 4))
        return stem + of(ENDINGS)[stream.below(len(of(ENDINGS)))]
    if kind.startswith("family"):
        parts = SYLLABLES[kind.split(":")[1]]
        return "".join(parts[stream.below(len(parts))] for _ in range(4 + attempt))
    if not any(c.isdigit() or c.isalpha() for c in canon):
        # symbols alone have nothing to scramble
        return "".join(SIGNS[stream.below(len(SIGNS))] for _ in range(len(canon) + attempt))
    if kind == "ssn":
        return scrambled(canon, stream) + "".join(str(stream.below(10)) for _ in range(attempt - LONG))
    # a form of few letters or digits may be exhausted: from the third attempt on it grows
    return scrambled(canon, stream) + "".join(SIGNS[stream.below(len(SIGNS))] for _ in range(attempt - 2))


def in_format(kind: str, mention: str, canon: str) -> str:
    """The replacement's canonical form written as the mention is: its separators and its case."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(canon)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind == "iban":
        signs = iter(canon)
        return "".join(next(signs) if c != " " else c for c in mention) + "".join(signs)
    if kind == "ipv6":
        return canon.upper() if mention.isupper() else canon
    if kind.startswith(("given", "family")):
        return canon.upper() if mention.isupper() and len(mention) > 1 else "-".join(p[:1].upper() + p[1:] for p in canon.split("-"))
    if kind == "email":
        return canon.upper() if mention.isupper() else canon
    return canon


def replaced(text: str, moved: dict[tuple[str, str], tuple[str, int]], key: bytes = KEY) -> tuple[str, int]:
    """The text with surrogates and how many entities it has. moved: the kind to take and the attempt of some entities."""
    out, at, found = [], 0, entities(text)
    for start, end, kind, canon in found:
        use, attempt = moved.get((kind, canon), (kind, 0))
        out += [text[at:start], in_format(use, text[start:end], surrogate(use, canon, attempt, key))]
        at = end
    return "".join([*out, text[at:]]), len(found)


def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct entities of a batch."""
    for batch in batches:
        seen = sorted({(k, c) for t in batch.column("text").to_pylist() if t for _, _, k, c in entities(t)})
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*seen)], ["kind", "canon"])


def one_kind(found: DataFrame) -> DataFrame:
    """kind, canon, use: the kind that stands for all under which an entity was found; only given names have several."""
    part = lambda k: F.element_at(F.split("kind", ":"), k)
    given = F.startswith("kind", F.lit("given:"))
    names = found.filter(given).groupBy("canon", part(3).alias("script")).agg(F.bool_or(part(2) == "m").alias("m"), F.bool_or(part(2) == "f").alias("f"))
    gender = F.when(F.expr("m and not f"), "m").when(F.expr("f and not m"), "f").otherwise("n")
    names = names.select("canon", "script", F.concat(F.lit("given:"), gender, F.lit(":"), "script").alias("use"))
    several = found.filter(given).distinct().withColumn("script", part(3)).join(names, ["canon", "script"]).select("kind", "canon", "use")
    return several.unionByName(found.filter(~given).distinct().withColumn("use", F.col("kind")))


def attempts_needed(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, canon, attempt of the distinct entities found (kind, canon), such that within a family of kinds no two have the
    same replacement and none is replaced by a real entity. Of several that collide the one of the lowest attempt, then
    the smallest form, keeps its own."""

    @F.pandas_udf(T.StringType())
    def named(kinds: pd.Series, canons: pd.Series, attempts: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, c, a, key) for k, c, a in zip(kinds, canons, attempts)], dtype="object")

    # given names of all genders and scripts are one family, so that a replacement stands for one name only
    family = F.split("kind", ":")[0]
    rows = stored(found.distinct().withColumn("attempt", F.lit(0)).withColumn("family", family).withColumn("to", named("kind", "canon", "attempt")))
    real = rows.select("family", F.col("canon").alias("to")).distinct()
    while True:
        owner = rows.groupBy("family", "to").agg(F.min(F.struct("attempt", "canon", "kind")).alias("own"), F.count("*").alias("n"))
        shared = rows.join(owner.filter("n > 1"), ["family", "to"]).filter(F.struct("attempt", "canon", "kind") != F.col("own")).select("family", "kind", "canon")
        unreal = rows.join(real, ["family", "to"], "left_semi").select("family", "kind", "canon")
        moving = stored(shared.unionByName(unreal).distinct().withColumn("move", F.lit(1)))
        if moving.isEmpty():
            return rows.select("kind", "canon", "attempt")
        bumped = rows.join(moving, ["family", "kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("move", F.lit(0)))
        rows = stored(bumped.select("kind", "canon", "attempt", "family", F.when(F.col("move").isNull(), F.col("to")).otherwise(named("kind", "canon", "attempt")).alias("to")))


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_entities", T.LongType())])


def with_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """docs with their entities replaced in text, and n_entities (long), how many there were.

    A null text stays null with 0 entities. Repeated rows get equal texts. Other columns stay, whatever their names; a
    column named n_entities is replaced. Texts of any length are searched whole, in time that grows with their length.
    Only entities whose first surrogate collided, or that were found as several kinds, are looked up; they are sent to the
    tasks if they are SENT_ROWS at most and otherwise joined to the texts that mention them.
    """
    spark = docs.sparkSession
    python_ready(spark)
    docs = docs.drop("n_entities")
    uses = stored(one_kind(stored(docs.select("text").mapInArrow(found_in, "kind string, canon string").distinct())))
    attempts = attempts_needed(uses.select(F.col("use").alias("kind"), "canon"), key).withColumnRenamed("kind", "use")
    moved = stored(uses.join(attempts, ["use", "canon"]).filter("attempt > 0 or use <> kind").select("kind", "canon", "use", "attempt"))
    rows = packed(docs, "text")
    if moved.count() <= SENT_ROWS:
        sent = spark.sparkContext.broadcast({(r.kind, r.canon): (r.use, r.attempt) for r in moved.collect()})
        rewrite = F.pandas_udf(lambda texts: pd.DataFrame([(None, 0) if t is None else replaced(t, sent.value, key) for t in texts], columns=["text", "n_entities"]), RESULT)
        out = rows.withColumn("new", rewrite("text"))
    else:
        mentions = F.pandas_udf(lambda texts: pd.Series([sorted({(k, c) for _, _, k, c in entities(t or "")}) for t in texts]), T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("canon", T.StringType())])))
        # a text's hash names it: where two texts share one, each finds its own entities in the list of both
        body = F.xxhash64("text").alias("body")
        pairs = docs.select(body, F.explode(mentions("text")).alias("m")).select("body", "m.*").distinct()
        listed = pairs.join(moved, ["kind", "canon"]).groupBy("body").agg(F.collect_list(F.struct("kind", "canon", "use", "attempt")).alias("moved"))
        rewrite = F.pandas_udf(lambda texts, lists: pd.DataFrame([(None, 0) if t is None else replaced(t, {} if m is None else {(x["kind"], x["canon"]): (x["use"], x["attempt"]) for x in m}, key) for t, m in zip(texts, lists)], columns=["text", "n_entities"]), RESULT)
        out = rows.select("*", body).join(listed, "body", "left").withColumn("new", rewrite("text", "moved"))
    out = out.select(F.col("new.text").alias("text"), "rest", F.col("new.n_entities").alias("n_entities"))
    return unpacked(out, docs, "text", more=("n_entities",))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_entities and the text with surrogates."""
    return with_surrogates(docs.select("doc_id", "text")).select("doc_id", "n_entities", "text")
