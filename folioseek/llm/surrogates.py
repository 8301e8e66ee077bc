"""Operator 6: personal data replaced by keyed, type-consistent surrogates.

Found are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card and account numbers, social security numbers,
secrets (access keys, hex and named tokens, passwords) and names behind a title, with every further capitalised mention of
their parts in the same document. An entity consists of units: the local
part and the domain of an address, the digits of a number, each part of a name. Every distinct unit of the whole input gets one
surrogate, so equal units stay equal and different ones different everywhere. The parts of names are one kind per script: a word
has one surrogate, whatever its titles and places, drawn as a given name of one gender or as a family name, as most mentions have it.

Not found: names that stand behind no title in their document, parts of a hyphenated name on their own, and later mentions in small letters
or, where the part is also a common word ("Will"), at the start of a sentence. A local part ends at letters of scripts
without spaces between words (Chinese, Japanese, Thai, and Hangul), unless such a letter stands directly before the @.

* A surrogate is drawn by HMAC from the secret key, the unit and the number of the attempt, in the unit's own form: letters for
  letters, digits for digits, octets for octets, given names of the same gender and script, Luhn and IBAN check digits kept valid.
* Collision checks are joins: a surrogate that another unit drew as well, that an earlier unit owns, or that is a real unit of
  the input goes to one unit at most (the least), and the others draw again, until none is left.
* A mention is written in its own way: punctuation, spacing and capitals of the text stay.

Only documents that hold entities are written and joined; others pass through. Null texts stay null. Rows, also repeated ones,
are replaced one by one. Columns of the input are returned as they came, the text changed, n_entities appended.
"""
from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.common import Scratch, arrow_schema, text_slices, with_columns
from folioseek.llm.html_text import STOP_WORDS

MAX_ATTEMPTS = 60
#: Attempts after which a unit may grow by a letter or digit, as the forms of its length may be used up.
GROW_AFTER = 12

#: Titles by gender, given names by gender and script, family names by script.
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Mademoiselle Mlle Señora Señorita Sra Srta госпожа г-жа".split(),
    "m": "Mr Mister Sir Lord Herr Monsieur Señor Sr господин г-н".split(),
    "n": "Dr Prof Professor Doctor Doktor Docteur доктор профессор".split(),
}
GIVEN = {
    ("f", "latin"): "Alma Berta Clara Dora Elena Flora Greta Hilda Irene Julia Karla Laura Marta Nora Olga Paula Rosa Sara Thea Vera".split(),
    ("m", "latin"): "Adam Bruno Carlo Denis Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oskar Paul Ralf Simon Theo Viktor".split(),
    ("n", "latin"): "Alex Andrea Chris Dana Eli Gabriel Jamie Jean Kim Kay Lee Luca Maxime Nico Robin Sam Sasha Sascha Toni Val".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Раиса Софья Тамара".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура Слава Паша Миша Никита Юра Вася".split(),
}
FAMILY = {
    "latin": "Abel Becker Castel Dorn Engel Ferro Garner Holm Ibsen Jansen Keller Lorca Moran Neri Orton Perrin Quint Rossi Silber Thorne Vidal Weller".split(),
    "cyrillic": "Авдеев Белов Волков Громов Дубов Ершов Зимин Козлов Лосев Мельник Носов Орлов Попов Рогов Седов Титов Фомин Чехов".split(),
}
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ra se ti vo wi zan der mar ten lin ros".split(),
    "cyrillic": "ба де фи го ку ла ме ни по ра се ти во зан дер мар тен лин рос".split(),
}

NAME_PART = r"[^\W\d_](?:[^\W\d_]|['’\-](?=[^\W\d_]))+"
TITLE_GENDER = {t.lower(): g for g, titles in TITLES.items() for t in titles}
DOMAIN = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"



def _spaced_letters() -> str:
    """Letters and marks beyond ASCII of the scripts that put spaces between words, as ranges of a character class."""
    blocks = ((0x80, 0xE00), (0xF00, 0x1000), (0x10A0, 0x1100), (0x1200, 0x1780), (0x1800, 0x1950), (0x1AB0, 0x2000), (0x2C00, 0x2E00), (0xA640, 0xA6A0), (0xA720, 0xA800))
    fits = [c for lo, hi in blocks for c in range(lo, hi) if chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M"]
    first = [c for i, c in enumerate(fits) if not i or fits[i - 1] != c - 1]
    last = [c for i, c in enumerate(fits) if i + 1 == len(fits) or fits[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))


SPACED = _spaced_letters()
UNSPACED = rf"[^\W\dA-Za-z_{SPACED}]"

#: In the order of precedence where matches overlap.
PATTERNS = {
    "email": re.compile(
        rf"(?P<local>[A-Za-z0-9._%+\-{SPACED}]+"
        rf"|(?:(?<![\w.%+\-])|(?<!{UNSPACED})(?={UNSPACED}))[\w.%+\-]*{UNSPACED})@(?P<domain>{DOMAIN})"
    ),
    "password": re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)[\"']?\s*[:=]\s*[\"']?(?P<secret>[^\s\"',;]{6,})"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?P<secret>AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_\-]{20,}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![\w.])(?P<ipv4>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\w|\.\d)"),
    "ipv6": re.compile(r"(?<![\w:])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    "ssn": re.compile(r"(?<![\w\-])(?P<digits>\d{3}-\d{2}-\d{4})(?![\w\-])"),
    "card": re.compile(r"(?<![\w.\-])(?P<card>\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}|\d{4}[ \-]?\d{6}[ \-]?\d{5})(?![\w\-]|\.\d)"),
    "phone": re.compile(r"(?<![\w.])(?P<digits>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\w|[.\-]\d)"),
    "name": re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted((re.escape(t) for g in TITLES.values() for t in g), key=len, reverse=True))})(?:\.\s?|\s)(?P<name>{NAME_PART}(?: {NAME_PART}){{0,2}})"),
}
#: A text without any of these has no entity.
NEEDED = {
    "email": re.compile(r"@"),
    "password": re.compile(r"(?i:passw|pwd|secret|token|key)"),
}
#: Kinds of the parts of names.
NAMES = ("given:", "family:")
LETTERS = re.compile(r"[^\W\d_]+")
MENTION = re.compile(rf"(?<!\w){NAME_PART}(?!\w)")
DIGIT = re.compile(r"[0-9]")
HEX = re.compile(r"[0-9A-Fa-f]{2}:|[0-9A-Fa-f]{32}|AKIA|ASIA|sk-|gh[pousr]_")


def found_in(text: str) -> list[tuple[int, int, str, str]]:
    """The units of a text: (start, end, unit type, canonical value), in order and apart."""
    digit = DIGIT.search(text) is not None
    rare = digit or HEX.search(text) is not None
    taken: list[tuple[int, int, list]] = []
    for kind, pattern in PATTERNS.items():
        if not (NEEDED[kind].search(text) if kind in NEEDED else rare or kind == "name"):
            continue
        for m in titled(text) if kind == "name" else pattern.finditer(text):
            units = units_of(kind, m)
            if kind == "name":  # the match may run into what follows the name
                units = [u for u in units if not any(a < u[1] and u[0] < b for a, b, _ in taken)]
                taken += [(u[0], u[1], [u]) for u in units]
                continue
            if units and not any(a < m.end() and m.start() < b for a, b, _ in taken):
                taken.append((m.start(), m.end(), units))
    units = sorted(u for _, _, units in taken for u in units)
    again = names_again(text, units)
    return sorted(units + again) if again else units


def titled(text: str) -> Iterator[re.Match]:
    """Titles with what may be a name; words behind the name are searched again, as they may be a title."""
    at = 0
    while m := PATTERNS["name"].search(text, at):
        yield m
        units = units_of("name", m)
        at = units[-1][1] if units else m.end("title")


def names_again(text: str, units: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further mentions of the parts of the names among `units`: capitalised whole words outside of all units."""
    kinds: dict[str, str] = {}
    for _, _, kind, value in units:
        if kind.startswith(NAMES) and (value not in kinds or kind.startswith("given:")):
            kinds[value] = kind
    if not kinds:
        return []
    out, ahead = [], 0

    def add(start: int, end: int) -> bool:
        value = text[start:end].lower()
        if value not in kinds or not text[start].isupper():
            return False
        if value not in STOP_WORDS or not re.search(r"(?:[.!?:;\n\"“„»¿¡]\s*|\A\s*)\Z", text[max(0, start - 20) : start]):
            out.append((start, end, kinds[value], value))
        return True

    for m in MENTION.finditer(text):
        while ahead < len(units) and units[ahead][1] <= m.start():
            ahead += 1
        if ahead < len(units) and units[ahead][0] < m.end() or add(*m.span()):
            continue
        if len(m[0]) > (whole := len(own_name(m[0]))) and add(m.start(), m.start() + whole):
            continue
        for part in LETTERS.finditer(text, *m.span()) if "-" in m[0] or "'" in m[0] or "’" in m[0] else ():
            add(*part.span())
    return out


def own_name(word: str) -> str:
    """A name without the 's of its owner."""
    return word[:-2] if len(word) > 3 and word[-2:].lower() in ("'s", "’s") else word


def units_of(kind: str, m: re.Match) -> list[tuple[int, int, str, str]]:
    if kind == "email":
        parts = m["local"].lower(), m["domain"].lower()
        return [(*m.span("local"), "local", parts[0]), (*m.span("domain"), "domain", parts[1])]
    if kind == "name":
        gender = TITLE_GENDER[m["title"].lower()]
        words, out, at = m["name"].split(" "), [], m.start("name")
        upper = []
        for w in words:  # a name ends at the first word in small letters and at another title
            if not w[0].isupper() or w.lower() in TITLE_GENDER:
                break
            upper.append(own_name(w))
            if len(upper[-1]) < len(w):
                break
        for i, w in enumerate(upper):
            script = "cyrillic" if "Ѐ" <= w[0] <= "ӿ" else "latin"
            type_ = f"family:{script}" if i == len(upper) - 1 else f"given:{gender}:{script}"
            out.append((at, at + len(w), type_, w.lower()))
            at += len(w) + 1
        return out
    (name, value), = ((k, v) for k, v in m.groupdict().items() if v is not None)
    span = m.span(name)
    if name in ("digits", "card"):
        digits = re.sub(r"\D", "", value)
        if name == "card" and not 13 <= len(digits) <= 19:
            return []
        if name == "digits" and len(digits) < 7:
            return []
        return [(*span, "card" if name == "card" else f"number:{'+' if value[0] == '+' else ''}", digits)]
    if name == "iban":
        return [(*span, "iban", value.replace(" ", ""))] if sum(c.isdigit() for c in value) >= 8 else []
    if name in ("ipv4", "ipv6"):
        try:
            return [(*span, name, str(ipaddress.ip_address(value)))]
        except ValueError:
            return []
    return [(*span, "secret", value)]


class Drawn:
    """A stream of small numbers drawn by HMAC."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.block, self.bytes = key, "\x1f".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        """Evenly in 0 .. n-1, for n up to 2^32."""
        while True:
            if len(self.bytes) < 4:
                self.bytes += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
                self.block += 1
            x, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
            if x < (1 << 32) // n * n:
                return x % n


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def same_classes(value: str, draw: Drawn) -> str:
    """Letters for letters, digits for digits, in the alphabet and case of each; a value of hex digits stays one."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) and re.search(r"[a-fA-F]", value) and len(value) >= 8:
        alphabet = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
        return "".join(alphabet[draw.below(16)] for _ in value)
    out = []
    for c in value:
        if "0" <= c <= "9":
            out.append(str(draw.below(10)))
        elif c.isalpha():
            x = "абвгдежзиклмнопрстуфхцчшэюя" if "Ѐ" <= c <= "ӿ" else "abcdefghijklmnopqrstuvwxyz"
            x = x[draw.below(len(x))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    """The canonical surrogate that a unit draws in an attempt."""
    draw = Drawn(key, kind, value, str(attempt))
    more = max(0, attempt - GROW_AFTER + 1) // 4 + (attempt >= GROW_AFTER)
    if kind == "ipv4":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ipv6":
        return str(ipaddress.IPv6Address((0x2001 << 112) + sum((1 + draw.below(0xFFFF)) << (16 * i) for i in range(7))))
    if kind == "card":
        body = value[0] + "".join(str(draw.below(10)) for _ in value[1:-1])
        last = next(d for d in "0123456789" if luhn(body + d)) if luhn(value) else str(draw.below(10))
        return body + last
    if kind.startswith("number:"):
        kept = 1 if kind.endswith("+") and value[0] in "17" and len(value) == 11 else 0  # a country code of one digit
        first = str(1 + draw.below(9)) if value[kept] != "0" else "0"
        return value[:kept] + first + "".join(str(draw.below(10)) for _ in value[kept + 1 :])
    if kind == "iban":
        body = same_classes(value[4:], draw)
        number = int("".join(str(int(c, 36)) for c in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "secret":
        head = next((h for h in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if value.startswith(h)), "")
        return head + same_classes(value[len(head) :], draw) + "".join(str(draw.below(10)) for _ in range(more))
    if kind == "domain":
        host, _, top = value.rpartition(".")
        return f"{same_classes(host, draw)}{''.join(chr(97 + draw.below(26)) for _ in range(more))}.{top}"
    if kind == "local":
        return same_classes(value, draw) + "".join(chr(97 + draw.below(26)) for _ in range(more))
    family, *rest = kind.split(":")
    script = rest[-1]
    names = FAMILY[script] if family == "family" else GIVEN[rest[0], script]
    name = names[draw.below(len(names))]
    if attempt >= 2:  # the lists are small: names are composed
        ending = name[-1] if family == "given" else ""  # the last letter carries the gender
        parts = [SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(1 + attempt // 3)]
        name = name[: 3 if family == "given" else None] + "".join(parts) + ending
    return name.lower()


def written_as(mention: str, kind: str, new: str) -> str:
    """The surrogate in the way of the mention."""
    if kind == "card" or kind.startswith("number:"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in mention)
    if kind in ("secret", "ipv4"):
        return new
    if kind == "ipv6":
        return new.upper() if mention != mention.lower() else new
    if kind in ("local", "domain"):
        if mention == mention.lower():
            return new
        return new.upper() if mention == mention.upper() else "".join(b.upper() if a.isupper() else b for a, b in zip(mention, new)) + new[len(mention) :]
    return new.upper() if len(mention) > 1 and mention.isupper() else "-".join(p.capitalize() for p in new.split("-"))


UNITS = "array<struct<start:int,end:int,kind:string,value:string>>"


def _plain(docs: DataFrame) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]


def _detected(docs: DataFrame, text: str, holding: bool) -> DataFrame:
    """Rows with entities and their units, or the rows without."""
    ddl = ", ".join([*_plain(docs), f"__units__ {UNITS}"] if holding else _plain(docs))
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            units = [found_in(t.decode("utf-8", "replace")) if t else [] for t in texts]
            some = batch.filter(pa.array([bool(u) == holding for u in units], pa.bool_()))
            if not some.num_rows:
                continue
            new = {"__units__": [[dict(zip(("start", "end", "kind", "value"), x)) for x in u] for u in units if u]}
            yield with_columns(some, schema, new if holding else {})

    return docs.mapInArrow(task, ddl)


def space_of(kind: str) -> Column:
    """The kinds within which values and surrogates are one to one: parts of names are one kind per script."""
    c = F.col(kind)
    return F.when(c.startswith(NAMES[0]) | c.startswith(NAMES[1]), F.concat(F.lit("name:"), F.substring_index(c, ":", -1))).otherwise(c)


def unit_kinds(mentions: DataFrame) -> DataFrame:
    """(kind, value): the distinct units; a part of a name has one kind, by the number of its mentions."""
    counts = mentions.groupBy("kind", "value").agg(F.count("*").alias("n")).withColumn("space", space_of("kind"))
    is_name = F.col("space").startswith("name:")
    others = counts.where(~is_name).select("kind", "value")

    def of(prefix: str) -> Column:
        return F.sum(F.when(F.col("kind").startswith(prefix), F.col("n")).otherwise(0))

    names = counts.where(is_name).groupBy("space", "value").agg(
        of("given:").alias("given"), of("family:").alias("family"), of("given:f:").alias("f"), of("given:m:").alias("m"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n")
    script = F.substring_index("space", ":", -1)
    given = (F.col("given") > 0) & (F.col("given") >= F.col("family"))
    kind = F.when(given, F.concat_ws(":", F.lit("given"), gender, script)).otherwise(F.concat(F.lit("family:"), script))
    return others.union(names.select(kind, "value"))


def surrogate_table(scratch: Scratch, units: DataFrame, key: bytes, draw: Callable[[str, str, bytes, int], str] = surrogate) -> DataFrame:
    """(kind, value, surrogate) for the distinct (kind, value): one to one within a space of kinds, and never a real value of it."""
    ddl = "kind string, value string, surrogate string"
    schema = arrow_schema(ddl)
    real = scratch.table(units.distinct(), "real")
    taken = real.select(space_of("kind").alias("space"), F.col("value").alias("surrogate"))
    left, done = real, None
    for attempt in range(MAX_ATTEMPTS):

        def task(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                drawn = pa.array([draw(k, v, key, attempt) for k, v in zip(kinds, values)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.string()), drawn], schema=schema)

        drawn = left.select("kind", "value").mapInArrow(task, ddl).withColumn("space", space_of("kind"))
        won = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("value", "kind")).alias("u"))
        won = won.join(taken, ["space", "surrogate"], "left_anti")
        if done is not None:
            won = won.join(done.select(space_of("kind").alias("space"), "surrogate"), ["space", "surrogate"], "left_anti")
        won = scratch.table(won.select("u.kind", "u.value", "surrogate"), "won")
        done = won if done is None else done.union(won)
        left = scratch.table(left.join(won, ["kind", "value"], "left_anti").select("kind", "value"), "left")
        if not left.limit(1).count():
            return done
    raise RuntimeError(f"no free surrogate for some units after {MAX_ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """`docs` with surrogates for all entities in column `text`, and n_entities (long; units: a mailbox and its domain are two)."""
    if "n_entities" in docs.columns:
        renamed = replace_entities(docs.withColumnRenamed("n_entities", "__given__"), key, text)
        return renamed.drop("n_entities").withColumnRenamed("__given__", "n_entities")
    scratch = Scratch(docs.sparkSession, "surrogates")
    holding = _detected(docs, text, True).withColumn("__row__", F.monotonically_increasing_id())
    holding = scratch.table(holding, "holding", lasting=True)
    mentions = holding.select("__row__", F.explode("__units__").alias("u")).select("__row__", "u.start", "u.kind", "u.value")
    table = surrogate_table(scratch, unit_kinds(mentions), key)
    table = scratch.table(table.select(space_of("kind").alias("space"), "value", "surrogate"), "surrogates", lasting=True)
    scratch.drop()
    drawn = mentions.withColumn("space", space_of("kind")).join(table, ["space", "value"]).groupBy("__row__")
    drawn = drawn.agg(F.map_from_entries(F.collect_list(F.struct("start", "surrogate"))).alias("__drawn__"))
    joined = holding.join(drawn, "__row__").drop("__row__")
    ddl = ", ".join([*_plain(docs), "n_entities long"])
    schema = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            units, drawn = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__units__", "__drawn__"))
            new = []
            for t, us, d in zip(texts, units, drawn):
                t, d, out, last = t.decode("utf-8", "replace"), dict(d), [], 0
                for u in us:
                    out += [t[last : u["start"]], written_as(t[u["start"] : u["end"]], u["kind"], d[u["start"]])]
                    last = u["end"]
                new.append("".join([*out, t[last:]]))
            yield with_columns(batch, schema, {text: new, "n_entities": list(map(len, units))}, drop=("__units__", "__drawn__"))

    replaced = joined.mapInArrow(task, ddl)
    return _detected(docs, text, False).withColumn("n_entities", F.lit(0).cast("long")).union(replaced)
