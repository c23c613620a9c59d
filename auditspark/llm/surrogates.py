"""Personal data and secrets get keyed surrogates of the same kind and format.

Detected: e-mail addresses, telephone numbers, IPv4 addresses, payment card numbers
(their check digit must hold), social security numbers, IBANs, access keys, assigned
secrets (``password=...``), names after a title, and wherever else in the document one
of these names stands as a capitalised word. A surrogate depends on a secret key, the
kind and the canonical value only, so one value has one surrogate everywhere
(coreference), whatever its separators or case at a place, which the surrogate takes
over: digits stay digits, letters stay letters of their case and script, marks stay
marks, a valid check digit stays valid, and a given name stays a name of the title's
gender; where only some titles of a document tell the gender, they tell it for all.

Distinctness is checked over the whole corpus: values whose surrogates meet each other
or an existing value draw again, smallest value first, until none do. From the draw
``WIDE`` on the space they draw from grows, by characters or, for IPv4 addresses that
are not public, by larger reserved ranges, so that no kind of few values runs out; if
values still meet after all rounds, it is an error and nothing is written.

Scale: one pass finds the distinct values, which are few next to the text; the check
is a shuffle of those; a second pass rewrites each text where it stands. Only the
values that drew again have to be sent along: by broadcast while they are at most
``SENT``, else joined to the texts that hold them.

Edge cases: null and empty texts stay; nothing found leaves a text byte for byte as it
is; repeated rows are rewritten alike; very long texts are scanned whole; extra columns
pass through.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .storage import Scratch, with_columns_free

#: For tests and this repository's queries; a deployment sets its own.
DEMO_KEY = b"not a secret"
#: Redrawn values that are broadcast at most.
SENT = 50_000
#: The draw from which surrogates may leave the format's small spaces.
WIDE = 8
#: Turns of one draw, before a surrogate grows by a character.
TURNS = 100
#: The session setting that holds the secret key.
KEY_SETTING = "auditspark.surrogates.key"

# Titles by gender, and syllables and given names by script.
_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "Κύριος")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "г-жа", "Κυρία")
_ANY = ("Dr", "Prof")
_GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Caspar", "Dario", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Oscar", "Paul", "Victor"),
    ("latin", "f"): ("Alma", "Bianca", "Clara", "Daria", "Elena", "Flora", "Greta", "Ida", "Laura", "Marta", "Nora", "Vera"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"),
    ("cyrillic", "f"): ("Алла", "Вера", "Дарья", "Елена", "Инна", "Мария", "Нина", "Ольга"),
    ("greek", "m"): ("Άρης", "Λέων", "Νίκος", "Πάνος", "Πέτρος", "Φίλιππος"),
    ("greek", "f"): ("Άννα", "Δάφνη", "Ελένη", "Ζωή", "Θάλεια", "Μαρία"),
}
_SYLLABLES = {
    "latin": ("ba", "del", "fen", "gor", "hal", "kin", "lor", "mar", "nel", "pos", "quin", "ras", "sol", "tem", "var", "wen"),
    "cyrillic": ("бал", "вер", "гор", "дан", "зор", "кал", "лен", "мир", "нов", "рад", "сол", "тар"),
    "greek": ("βαλ", "γαρ", "δελ", "καλ", "λεν", "μαρ", "νικ", "παν", "ραν", "σολ", "ταρ", "φιλ"),
}

_LOCAL = re.compile(r"[\w.%+-]")
_EMAIL_RIGHT = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_NUMBER = re.compile(r"(?<![\w@])(?<!\d[.,-])[+(]*\d[\d ().+-]{5,}\d(?![\w@])")
_IPV4 = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")
_CARD = re.compile(r"(?<![\d.])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?!\d)")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_ACCESS = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:ghp_|gho_|sk-|xoxb-)[A-Za-z0-9_-]{16,}")
_SECRET = re.compile(r"""(?i)(?<!\w)(?:passwords?|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?token)["']?\s*[=:]\s*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"',;]{6,}))""")
_NAME = re.compile(r"(?<!\w)(" + "|".join(sorted((*_MALE, *_FEMALE, *_ANY), key=len, reverse=True)) + r")\.?[  ]((?:[^\W\d_a-z][^\W\d_]+[  -]){0,2}[^\W\d_a-z][^\W\d_]+)")
_WORD = re.compile(r"[^\W\d_]+")
_CAPITALISED = re.compile(r"(?<![\w@])[^\W\d_a-z][^\W\d_]+(?![\w@])")
#: Marks that stand for each other in a secret without letters and digits.
_MARKS = "!#$%&*+-./:=?@^_~"


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin" if c < 0x250 else "other"


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """The words of names after titles, and the same words elsewhere in the text."""
    titled: list[tuple[int, int, str, str]] = []
    genders: dict[str, set[str]] = {}
    family: set[str] = set()
    for m in _NAME.finditer(text):
        gender = "m" if m[1] in _MALE else "f" if m[1] in _FEMALE else ""
        words = [*_WORD.finditer(text, *m.span(2))]
        for w in words[:-1]:
            genders.setdefault(w[0].lower(), set()).add(gender)
            titled.append((*w.span(), gender, w[0].lower()))
        family.add(words[-1][0].lower())
        titled.append((*words[-1].span(), "surname", words[-1][0].lower()))
    if not titled:
        return []

    def given(value: str, own: str = "") -> str:
        told = genders[value] - {""}
        return f"given:{own or (next(iter(told)) if len(told) == 1 else 'mf')}"

    found = [(a, b, kind if kind == "surname" else given(value, kind), value) for a, b, kind, value in titled]
    at = {a for a, *_ in titled}
    words = [m for m in _CAPITALISED.finditer(text) if m[0][0].isupper()]
    for m, after in zip(words, [*words[1:], None], strict=True):
        value = m[0].lower()
        if m.start() in at or (value not in family and value not in genders):
            continue
        # A word that is both is a given name before a surname.
        first = value in genders and (value not in family or (after is not None and after.start() == m.end() + 1 and after[0].lower() in family))
        found.append((*m.span(), given(value) if first else "surname", value))
    return found


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value) of every detected unit, in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        if right := _EMAIL_RIGHT.match(text, at + 1):
            left = at
            while left and _LOCAL.match(text, left - 1):
                left -= 1
            if left < at:
                found.append((left, right.end(), "email", text[left : right.end()].lower()))
        at = text.find("@", at + 1)
    for m in _SECRET.finditer(text) if "=" in text or ":" in text else ():
        g = next(i for i in (1, 2, 3) if m[i] is not None)
        found.append((*m.span(g), "secret", m[g]))
    if "AKIA" in text or "ASIA" in text or "gh" in text or "sk-" in text or "xoxb-" in text:
        found.extend((*m.span(), "access", m[0]) for m in _ACCESS.finditer(text))
    for m in _NUMBER.finditer(text):
        run, base = m[0], m.start()
        for hit in _IPV4.finditer(run):
            if all(int(x) < 256 for x in hit[0].split(".")):
                found.append((base + hit.start(), base + hit.end(), "ipv4", ".".join(str(int(x)) for x in hit[0].split("."))))
        for kind, pattern in (("ssn", _SSN), ("phone", _PHONE), ("card", _CARD)):
            for hit in pattern.finditer(run):
                digits = re.sub(r"\D", "", hit[0])
                if kind != "card" or (digits[0] in "23456" and _luhn(digits) == 0):
                    found.append((base + hit.start(), base + hit.end(), kind, digits))
    if re.search(r"[A-Z]{2}\d\d", text):
        for m in _IBAN.finditer(text):
            value = m[0].replace(" ", "")
            if 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                found.append((*m.span(), "iban", value))
    found.extend(_names(text))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class _Stream:
    """Keyed pseudo-random numbers for one value and draw."""

    def __init__(self, key: bytes, kind: str, value: str, draw: int):
        self.seed = hashlib.blake2b(f"{kind}\0{value}\0{draw}".encode(), key=key[:64], digest_size=32).digest()
        self.count, self.pool = 0, 0

    def below(self, n: int) -> int:
        if self.pool < n << 64:
            self.count += 1
            self.pool = (self.pool << 512) | int.from_bytes(hashlib.blake2b(self.seed + self.count.to_bytes(4, "big")).digest(), "big")
        self.pool, out = divmod(self.pool, n)
        return out


def _like(text: str, s: _Stream) -> str:
    """Other characters of the same classes; lower-case hexadecimal stays that, and marks change only where there is nothing else."""
    if text and not any(c.isalnum() for c in text):
        return "".join(c if c.isspace() else _MARKS[s.below(len(_MARKS))] for c in text)
    letters = "abcdef" if re.fullmatch(r"[0-9a-f]*", text) else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append(str(s.below(10)))
        elif "a" <= c <= "z":
            out.append(letters[s.below(len(letters))])
        elif "A" <= c <= "Z":
            out.append(chr(65 + s.below(26)))
        elif c.isalpha():
            # Another letter of the same case from the same 32 characters of its script.
            near = [x for x in map(chr, range(ord(c) & ~31, (ord(c) | 31) + 1)) if x.isalpha() and x.isupper() == c.isupper()]
            out.append(near[s.below(len(near))])
        else:
            out.append(c)
    return "".join(out)


def _reserved(value: str, draw: int, s: _Stream) -> str:
    """Another address that is not public, as near as the draw allows."""
    if draw >= 2 * WIDE:
        return f"{240 + s.below(15)}.{'.'.join(str(s.below(256)) for _ in range(3))}"
    if draw >= WIDE:
        return f"10.{'.'.join(str(s.below(256)) for _ in range(3))}"
    parts = value.split(".")
    if value.startswith(("192.0.0.", "192.0.2.", "198.51.100.", "203.0.113.")):
        # The rest of these /16 is public.
        return f"{'.'.join(parts[:3]) if parts[:3] != ['192', '0', '0'] else '192.0.2'}.{1 + s.below(254)}"
    fixed = 1 if parts[0] in ("10", "127") else 2
    return ".".join([*parts[:fixed], *(str(1 + s.below(254)) for _ in range(4 - fixed))])


def surrogate(key: bytes, kind: str, value: str, draw: int = 0) -> str:
    """The canonical surrogate of a canonical value; never the value itself."""
    more = max(0, draw.bit_length() - WIDE.bit_length() + 1)
    turn = -1
    while True:
        turn += 1
        # What cannot change, as a letter that is alone in its script, grows.
        more += turn > TURNS
        s = _Stream(key, kind, value, draw * 1000 + turn)
        if kind == "email":
            local, _, domain = value.partition("@")
            labels = domain.split(".")
            keep = 2 if len(labels) > 2 else 1
            # The domain has a surrogate of its own, so that colleagues stay colleagues.
            d = _Stream(key, "domain", domain, 0)
            out = f"{_like(local, s)}{_like('x' * more, s)}@{'.'.join([*(_like(x, d) for x in labels[:-keep]), *labels[-keep:]])}"
        elif kind == "ipv4":
            if ipaddress.ip_address(value).is_private:
                out = _reserved(value, draw, s)
            else:
                out = ".".join(str(1 + s.below(254 if i else 223)) for i in range(4))
                if ipaddress.ip_address(out).is_private:
                    continue
        elif kind == "card":
            out = value[0] + _like(value[1:-1], s)
            check = (10 - _luhn(out + "0")) % 10
            out += str(check if _luhn(value) == 0 else (check + 1 + s.below(9)) % 10)
        elif kind == "ssn":
            out = f"{900 + s.below(100)}{_like(value[3:], s)}"
        elif kind == "phone":
            keep = max(0, len(value) - 10)
            out = value[:keep] + _like(value[keep:] + "0" * more, s)
        elif kind == "iban":
            body = _like(value[4:], s)
            rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
            out = f"{value[:2]}{98 - rest % 97:02d}{body}"
        elif kind == "access":
            prefix = re.match(r"AKIA|ASIA|gh[po]_|sk-|xoxb-", value)[0]
            out = prefix + _like(value[len(prefix) :] + value[-1:] * more, s)
        elif kind.startswith("given"):
            script, gender = _script(value), kind.partition(":")[2]
            names = [n for g in gender for n in _GIVEN.get((script, g), ())]
            # More people than names: a draw beyond the first adds a syllable.
            out = names[s.below(len(names))].lower() if names else _like(value + value[-1:] * more, s)
            out += "".join(_SYLLABLES[script][s.below(len(_SYLLABLES[script]))] for _ in range(draw and 1 + draw.bit_length() // 2)) if names else ""
        elif kind == "surname" and _script(value) in _SYLLABLES:
            parts = _SYLLABLES[_script(value)]
            out = "".join(parts[s.below(len(parts))] for _ in range(3 + draw.bit_length() // 2))
        else:
            out = _like(value, s)
            out += _like("x" * more, s) if kind == "secret" else _like(value[-1:] * more, s)
        if out != value:
            return out


def _shaped(out: str, like: str, kind: str) -> str:
    """A canonical surrogate with the separators and case of one occurrence."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(out)
        return "".join([*(next(rest) if c.isalnum() else c for c in like), *rest])
    if kind.startswith("given") or kind == "surname":
        return out.upper() if like.isupper() and len(like) > 1 else out[0].upper() + out[1:]
    if kind == "email" and like != like.lower():
        return "".join(c.upper() if i < len(like) and like[i].isupper() else c for i, c in enumerate(out))
    return out


def rewrite(text: str, key: bytes, redrawn: dict[tuple[str, str], int], known: dict[tuple[str, str], str]) -> tuple[str, int]:
    found, parts, at = find(text), [], 0
    for a, b, kind, value in found:
        if (kind, value) not in known:
            known[kind, value] = surrogate(key, kind, value, redrawn.get((kind, value), 0))
        parts += (text[at:a], _shaped(known[kind, value], text[a:b], kind))
        at = b
    return "".join((*parts, text[at:])), len(found)


def _values(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.small_batches(batches):
            got = {(k, v) for t in batch.column(0).to_pylist() if t for _, _, k, v in find(t)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([v for _, v in got], pa.string())], names=["kind", "value"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string").distinct()


def _drawn(values: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [surrogate(key, *x) for x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], names=["kind", "value", "draw", "out"])

    return values.select("kind", "value", "draw").mapInArrow(run, "kind string, value string, draw int, out string")


def redrawn_values(values: DataFrame, key: bytes, scratch: Scratch, rounds: int = 500) -> DataFrame:
    """(kind, value, draw) of the values whose first surrogate met another surrogate or a value."""
    group = F.split("kind", ":")[0]
    now = scratch.save(_drawn(values.withColumn("draw", F.lit(0)), key))
    for _ in range(rounds):
        first = Window.partitionBy(group, "out").orderBy("value", "kind")
        met = now.select("kind", "value", "draw", F.row_number().over(first).alias("r"))
        taken = now.alias("n").join(values.select(group.alias("g"), F.col("value").alias("other")).distinct(), (F.split("n.kind", ":")[0] == F.col("g")) & (F.col("out") == F.col("other")), "left_semi").select("kind", "value", "draw")
        again = scratch.save(met.where("r > 1").select("kind", "value", "draw").union(taken).distinct())
        if not again.limit(1).count():
            break
        new = _drawn(again.withColumn("draw", F.col("draw") + 1), key)
        last, now = now, scratch.save(now.join(again, ["kind", "value"], "left_anti").unionByName(new))
        scratch.drop(last, again)
    else:
        raise RuntimeError(f"values still share surrogates after {rounds} rounds")
    return now.where("draw > 0").select("kind", "value", "draw")


def session_key(spark: SparkSession) -> bytes:
    """The secret key that the session sets, else ``DEMO_KEY``."""
    return spark.conf.get(KEY_SETTING, DEMO_KEY.decode()).encode()


def pseudonymised(spark: SparkSession, docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``, the units replaced. ``key``: else the session's."""
    key = key or session_key(spark)
    scratch = Scratch(spark, "surrogates")
    docs = with_columns_free(docs, "n_entities", "_redrawn")
    values = scratch.save(_values(docs))
    redrawn = scratch.save(redrawn_values(values, key, scratch))
    names, n = docs.columns, redrawn.limit(SENT + 1).count()
    given = docs.withColumn("text", F.col("text").cast("string"))
    sent = None
    if n > SENT:
        k = F.xxhash64("text")

        def places(batches):
            for b in B.small_batches(batches):
                rows = {(h, kind, value) for h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if t for _, _, kind, value in find(t)}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["k", "kind", "value"])

        own = given.select(k.alias("k"), "text").mapInArrow(places, "k long, kind string, value string").join(redrawn, ["kind", "value"])
        own = own.distinct().groupBy("k").agg(F.collect_list(F.struct("kind", "value", "draw")).alias("_redrawn"))
        given = given.withColumn("k", k).join(own, "k", "left").select(*names, "_redrawn")
    else:
        sent = spark.sparkContext.broadcast({(r.kind, r.value): r.draw for r in redrawn.collect()})
        given = given.select(*names, F.lit(None).cast("array<struct<kind:string,value:string,draw:int>>").alias("_redrawn"))
    at = names.index("text")

    def run(batches):
        known: dict[tuple[str, str], str] = {}
        for batch in B.small_batches(batches):
            texts, counts = [], []
            for t, own in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if sent is None:
                    known = {}
                elif len(known) > 100_000:
                    known.clear()
                drawn = {(x["kind"], x["value"]): x["draw"] for x in own or ()} if sent is None else sent.value
                new, n = rewrite(t, key, drawn, known) if t else (t, 0)
                texts.append(new)
                counts.append(n)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, "n_entities"])

    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in names), "n_entities long"])
    return given.mapInArrow(run, schema)
