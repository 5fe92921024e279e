"""PII surrogates: detected entities get keyed replacements of the same type, script, gender and format.

One expression finds e-mail addresses, IP addresses, keys, secrets, card numbers, IBANs, social security
and phone numbers, and persons: names behind a form of address, a known given name with a surname, or two names
behind words that announce one ("name is", "signed by"); initials may stand before the last name. An entity is made of
units: an address of its local part and its host, a name of a given name and a surname, anything else of itself.
Initials are moved along their alphabet by a step that the key gives. Every distinct unit draws a surrogate from a keyed digest, so equal units in any form
and any document have equal surrogates: "Mr John Smith", "Dr Smith" and "John Smith" share theirs. A name
without a gender takes that of the same surname in its text, else in all texts, if there is only one. Where a
text holds a person, the bare full name and surname are replaced in it too.

Draws that collide with each other or with a real unit are made anew until none does, so distinct entities
stay distinct. Only the losers draw again, and names and local parts grow with every further draw, so they
never run out.

Only DataFrame functions. Texts without entities pass in a projection. The texts that have some are
shuffled once, by a digest of the text; the units are folded to distinct ones before they meet, and all
joins are ones whose hot partitions Spark splits.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteweave.llm.common import let, read, written

TITLES = {"f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа"), "m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "n": ("Dr", "Prof")}
#: Given names that tell a person without a title, by gender. Names that are common words too are left out.
GIVEN = {
    "f": ("Aisha", "Alice", "Ana", "Andrea", "Angela", "Anna", "Barbara", "Carmen", "Caroline", "Catherine", "Charlotte", "Claudia", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Fatima", "Hannah", "Helen", "Isabel", "Jane", "Jennifer", "Jessica", "Julia", "Karen", "Katharina", "Laura", "Linda", "Lisa", "Lucia", "Margaret", "Maria", "Marie", "Martha", "Mary", "Mei", "Monika", "Nancy", "Natalia", "Nicole", "Nina", "Olga", "Patricia", "Priya", "Rachel", "Sabine", "Sandra", "Sarah", "Sofia", "Sophie", "Susan", "Ursula", "Yuki", "Анна", "Елена", "Мария", "Ольга"),
    "m": ("Adam", "Ahmed", "Alan", "Alexander", "Ali", "Andrew", "Antonio", "Benjamin", "Brian", "Carlos", "Charles", "Christian", "Daniel", "David", "Diego", "Edward", "Eric", "Fernando", "Francisco", "François", "George", "Hans", "Henry", "Jacques", "James", "Javier", "Jean", "John", "Joseph", "José", "Juan", "Jürgen", "Kevin", "Klaus", "Louis", "Luis", "Manuel", "Martin", "Matthew", "Michael", "Miguel", "Mohammed", "Muhammad", "Nicolas", "Oliver", "Omar", "Pablo", "Paul", "Peter", "Philippe", "Pierre", "Raj", "Richard", "Robert", "Simon", "Stefan", "Steven", "Thomas", "Wei", "Wolfgang", "William", "Дмитрий", "Иван", "Сергей"),
}
_BY_GENDER = {g: [x for t in ts for x in dict.fromkeys((t, t.upper()))] for g, ts in TITLES.items()}
_TITLE = "|".join(t for g in ("f", "m", "n") for t in _BY_GENDER[g])
_GIVEN = "|".join(sorted(n for names in GIVEN.values() for n in names))
_NAME = r"\p{Lu}[\p{L}'’-]+"
_INITIAL = r"\p{Lu}\."
_FULL = rf"{_NAME}(?: {_INITIAL}){{0,3}} {_NAME}"
#: Words that announce a name, whatever the given name is.
_CUE = r"[Nn]ame is|[Nn]ame:|[Ss]igned by|[Aa]uthor:|[Cc]ontact:|[Pp]atient:"
_PERSON = rf"(?=\p{{Lu}})(?<![\p{{L}}\d])(?:(?:{_TITLE})\.? (?:{_INITIAL} ){{0,3}}{_NAME}(?:(?: {_INITIAL}){{0,3}} {_NAME})?|(?:{_GIVEN})(?: {_INITIAL}){{0,3}} {_NAME}|(?<=(?:{_CUE}) ){_FULL})"
_SECRET_NAMES = ("password", "passwd", "token", "secret", "api_key", "apikey")
#: Version 4, or version 6 written out or with one gap, of five digits and more.
_IP = (r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)"
       r"|(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?::{0,2}[0-9A-Fa-f]){5})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")
#: In this order; where several could start at a place, the first does. A repeated group is possessive, for
#: Java's matcher would recurse once for each repeat and end the executor on a long run.
PATTERNS = (
    ("email", r"(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    ("key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", rf"(?<=(?i:{'|'.join(_SECRET_NAMES)})[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?)[A-Za-z0-9_+/-]{{8,}}"),
    ("ip", _IP),
    ("card", r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"),
    ("person", _PERSON),
)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS).replace(r"([ -]?)", r"(?<gap>[ -]?)").replace(r"\1", r"\k<gap>")
_HEX, _DIGITS, _LOWER, _UPPER = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Syllables of names, as many for each script; and the ends of given names (or only names) by gender.
SYLLABLES = {
    "cyrillic": (["ба", "ве", "ги", "до", "жа", "зе", "ка", "лу", "ми", "но", "пе", "ри", "са", "ту", "фе", "ча"], {"f": "ина", "m": "ин", "n": "енко"}),
    "greek": (["βα", "γε", "δι", "ζο", "θα", "κε", "λα", "μι", "νο", "πα", "ρε", "σι", "το", "φα", "χε", "ψι"], {"f": "ου", "m": "ης", "n": "ας"}),
    "latin": (["ba", "ce", "di", "fo", "ga", "he", "ka", "lo", "mi", "nu", "pe", "ri", "sa", "to", "ve", "zi"], {"f": "na", "m": "ner", "n": "land"}),
}


def has_entities(text: Column) -> Column:
    """Whether a text can hold an entity: a few fast looks before the expression itself."""
    t = F.coalesce(text, F.lit(""))
    quick = F.contains(t, F.lit("@")) | F.contains(t, F.lit("AKIA")) | F.rlike(t, F.lit(r"[0-9]{2}|[0-9]\.[0-9]|::|:[0-9A-Fa-f]{1,4}:")) | F.rlike(t, F.lit(rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLE})\.?|{_GIVEN}) \p{{Lu}}|(?:{_CUE}) \p{{Lu}}"))
    quick = quick | F.rlike(t, F.lit(f"(?i:{'|'.join(_SECRET_NAMES)})"))
    return quick & F.rlike(t, F.lit(ENTITY))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def kind_of(entity: Column) -> Column:
    """The type of an entity by its own string."""
    whole = F.coalesce(*[F.when(F.rlike(entity, F.lit(f"^(?:{p})$")), F.lit(k)) for k, p in PATTERNS if k != "secret"])
    announced = F.when(F.rlike(entity, F.lit(f"^{_FULL}$")), F.lit("person"))  # what announces it is outside the string
    return F.coalesce(whole, announced, F.lit("secret"))


def _initial(word: Column) -> Column:
    return F.rlike(word, F.lit(f"^{_INITIAL}$"))


def _words(person: Column) -> Column:
    """The names and initials of a person, without the form of address."""
    return F.split(F.regexp_replace(person, rf"^(?:{_TITLE})\.? ", ""), " ")


def _name_parts(entity: Column) -> Column:
    """``struct<gender, given, surname>`` of a person, without initials; a single name is a surname unless it is a known given one."""
    title = F.regexp_extract(entity, rf"^({_TITLE})\.? ", 1)
    of = lambda c, table: F.when(c.isin(list(table["f"])), "f").when(c.isin(list(table["m"])), "m")
    parts = F.filter(_words(entity), lambda w: ~_initial(w))
    def known(ws: Column) -> Column:
        alone = (F.size(ws) == 1) & of(ws[0], GIVEN).isNotNull()
        given, surname = F.when((F.size(ws) == 2) | alone, ws[0]), F.when(F.size(ws) == 2, F.get(ws, F.lit(1))).when(~alone, ws[0])
        return F.struct(F.coalesce(of(title, _BY_GENDER), of(given, GIVEN), F.lit("n")).alias("gender"), given.alias("given"), surname.alias("surname"))
    return let(parts, known)


def normal_form(kind: Column, entity: Column) -> Column:
    """What equal entities (but persons) have in common: e-mail and IP addresses in lower case, numbers by their
    digits (phones by the last ten)."""
    return (F.when(kind.isin("email", "ip"), F.lower(entity)).when(kind.isin("card", "ssn"), _digits(entity))
            .when(kind == "phone", F.right(_digits(entity), F.lit(10))).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).otherwise(entity))


def _draw(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _digest(key: str, *parts: Column) -> Column:
    inner = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)
    return F.sha2(F.concat(F.lit(key), inner), 512)


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _flag(value: Column) -> Column:
    return F.rlike(value, F.lit("^[0-9a-f]{8,}$")) & F.rlike(value, F.lit("[a-f]")) & F.rlike(value, F.lit("[0-9]"))


def _at(alphabet: str, b: Column) -> Column:
    return F.get(F.array(*map(F.lit, alphabet)), b % len(alphabet))


def _recast(value: Column, digest: Column) -> Column:
    """Each letter and digit of a value as another of its class; hexadecimal strings (eight characters and more, with a
    letter and a digit) stay so. The value, its flag and the digest are bound once, outside the loop over its characters."""
    def made(b: Column) -> Column:
        # what each character is, told by one pass over the value, and its draw by its place in the digest
        told = F.translate(b["v"], _DIGITS + _LOWER + _UPPER, "0" * 10 + "a" * 26 + "A" * 26)
        drawn = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: _byte(b["d"], i))
        def one(n: Column) -> Column:
            draw = lambda c, k, i: F.when(b["h"], _at(_HEX, F.get(n, i % 64))).when(k == "0", _at(_DIGITS, F.get(n, i % 64))).when(k == "a", _at(_LOWER, F.get(n, i % 64))).when(k == "A", _at(_UPPER, F.get(n, i % 64))).otherwise(c)
            each = F.arrays_zip(F.split(b["v"], "").alias("c"), F.split(told, "").alias("k"))
            return F.array_join(F.transform(each, lambda x, i: draw(x["c"], x["k"], i)), "")
        return let(drawn, one)

    return let(value, lambda v: let(F.struct(v.alias("v"), _flag(v).alias("h"), digest.alias("d")), made))


def luhn(digits: Column) -> Column:
    """The checksum of a string of digits, mod 10 (0 for a valid card number)."""
    n = F.length(digits)
    d = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, d(i)).otherwise(F.when(d(i) * 2 > 9, d(i) * 2 - 9).otherwise(d(i) * 2))) % 10


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN's rearranged string, letters as 10 to 35."""
    code = lambda c: F.when(F.rlike(c, F.lit("[0-9]")), c).otherwise((F.ascii(c) - 55).cast("string"))
    digits = F.array_join(F.transform(F.split(value, ""), code), "")
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda r, c: (r * 10 + F.coalesce(c.cast("int"), F.lit(0))) % 97)


def _name(digest: Column, syllables: list[str], count: Column) -> Column:
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.get(F.array(*map(F.lit, syllables)), _byte(digest, j) % 16))
    return F.array_join(made, "")


def _name_unit(kind: Column, norm: Column, digest: Column, count: Column) -> Column:
    """A surname, or a given name with the end of its gender, in the script of the real one. Cyrillic surnames
    have such ends too."""
    gender, name = F.substring(norm, F.lit(1), F.lit(1)), F.substring(norm, F.lit(3), F.length(norm))
    def of(script: str) -> Column:
        syllables, ends = SYLLABLES[script]
        end = F.when(gender == "f", ends["f"]).when(gender == "m", ends["m"]).otherwise(ends["n"])
        return F.concat(_name(digest, syllables, count), F.when((kind == "given") | F.lit(script == "cyrillic"), end).otherwise(F.lit("")))
    return F.initcap(F.when(F.rlike(name, F.lit(r"\p{IsCyrillic}")), of("cyrillic")).when(F.rlike(name, F.lit(r"\p{IsGreek}")), of("greek")).otherwise(of("latin")))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str, syllables: Column | int = 3) -> Column:
    """The keyed draw for a unit's type and normal form. ``local`` has its host behind an @, names their gender
    before a colon. A name has as many syllables and one more for each further attempt; a local part gets
    digits from the third attempt on."""
    count = (F.lit(syllables) if isinstance(syllables, int) else syllables) + attempt
    def drawn(d: Column) -> Column:
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - 1, F.lit(1))), lambda j: _draw(_DIGITS, _byte(d, j + 40))), "")
        local = F.concat(_recast(F.substring_index(norm, "@", 1), d), F.when(attempt >= 2, more).otherwise(F.lit("")), F.lit("@"), F.substring_index(norm, "@", -1))
        host = F.concat(_recast(F.regexp_extract(norm, r"^(.*)\.[^.]*$", 1), d), F.when(attempt >= 2, more).otherwise(F.lit("")), F.regexp_extract(norm, r"(\.[^.]*)$", 1))
        card = let(F.concat(F.substring(norm, F.lit(1), F.lit(1)), F.substring(_recast(norm, d), F.lit(2), F.length(norm) - 2)), lambda c: F.concat(c, ((luhn(norm) - luhn(F.concat(c, F.lit("0"))) + 10) % 10).cast("string")))
        ip = F.concat_ws(".", (_byte(d, F.lit(0)) % 223 + 1).cast("string"), _byte(d, F.lit(1)).cast("string"), _byte(d, F.lit(2)).cast("string"), (_byte(d, F.lit(3)) % 254 + 1).cast("string"))
        # a version 6 address keeps its form; one that has lost twice gets all its 128 bits, so such never run out
        hexed = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(_at(_HEX, _byte(d, i)))), "")
        ip6 = F.when(attempt >= 2, F.concat_ws(":", *[F.substring(d, 4 * i + 1, 4) for i in range(8)])).otherwise(hexed)
        ip = F.when(F.contains(norm, F.lit(":")), ip6).otherwise(ip)
        aws = F.concat(F.lit("AKIA"), *[_draw(_UPPER + "234567", _byte(d, F.lit(i))) for i in range(16)])
        phone = F.concat(_draw("23456789", _byte(d, F.lit(63))), F.substring(_recast(norm, d), F.lit(2), F.length(norm)))
        land, account = F.substring(norm, F.lit(1), F.lit(2)), F.substring(_recast(norm, d), F.lit(5), F.length(norm))
        iban = let(account, lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))
        return (F.when(kind == "local", local).when(kind == "host", host).when(kind == "card", card).when(kind == "ip", ip).when(kind == "key", aws)
                .when(kind == "phone", phone).when(kind == "iban", iban).when(kind.isin("given", "surname"), _name_unit(kind, norm, d, count)).otherwise(_recast(norm, d)))
    return let(_digest(key, kind, norm, attempt.cast("string")), drawn)


#: The capitals that initials are moved along, each in its own alphabet.
_CAPITALS = (_UPPER, "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")


def _moved(word: Column, key: str) -> Column:
    """An initial moved along its alphabet by the key's step (never by none)."""
    step = int(hashlib.sha256(f"initials\x1f{key}".encode()).hexdigest(), 16)
    to = "".join(a[1 + step % (len(a) - 1) :] + a[: 1 + step % (len(a) - 1)] for a in _CAPITALS)
    return F.translate(word, "".join(_CAPITALS), to)


def written_as(kind: Column, entity: Column, sur: Column, key: str) -> Column:
    """Surrogates of an entity's units (an array) in its form: its separators, title, initials and capitals."""
    one = F.get(sur, F.lit(0))
    total = F.length(_digits(entity))
    skip = total - F.length(one)
    filled = F.array_join(F.transform(F.split(entity, ""), lambda c, i: let(F.length(_digits(F.substring(entity, F.lit(1), i))), lambda before: F.when(F.rlike(c, F.lit("[0-9]")) & (before >= skip), F.substring(one, before - skip + 1, F.lit(1))).otherwise(c))), "")
    spaced = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(one, F.length(F.replace(F.substring(entity, F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1)))), "")
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    loud = lambda was, new: F.when((F.upper(was) == was) & (F.length(was) > 1), F.upper(new)).otherwise(new)
    before = lambda ws, i: F.size(F.filter(F.slice(ws, F.lit(1), i), lambda w: ~_initial(w)))
    name = let(_words(entity), lambda ws: F.array_join(F.transform(ws, lambda w, i: F.when(_initial(w), _moved(w, key)).otherwise(loud(w, F.get(sur, before(ws, i))))), " "))
    mail = F.concat(F.substring_index(one, "@", 1), F.lit("@"), F.get(sur, F.lit(1)))
    return (F.when(kind.isin("card", "ssn", "phone"), filled).when(kind == "iban", spaced)
            .when(kind == "email", F.when(F.upper(entity) == entity, F.upper(mail)).otherwise(mail))
            .when(kind == "person", F.concat(title, name)).when((kind == "ip") & F.rlike(entity, F.lit("[A-F]")), F.upper(one)).otherwise(one))


def _real(kind: Column, norm: Column) -> Column:
    """What a surrogate of the kind must not be: the real name without its gender, the real value. A local part
    may be any, for its host is another one."""
    return F.when(kind.isin("given", "surname"), F.lower(F.substring(norm, 3, 1_000_000))).when(kind != "local", F.lower(norm))


def surrogates(units: DataFrame, key: str) -> DataFrame:
    """``kind, norm, sur`` for distinct (kind, norm): no two of a kind share a surrogate, and none equals
    a real one. Each round draws only for those that have lost; the first length of names comes from the number of units,
    so that few do."""
    real = written(units.select("kind", "norm").distinct(), "units")
    digits, n = 3, real.filter("kind IN ('given', 'surname')").count()
    while 16 ** (digits - 1) < n:
        digits += 1
    taken = real.select("kind", _real(F.col("kind"), F.col("norm")).alias("s")).filter("s IS NOT NULL").distinct()
    done: list[DataFrame] = []
    left = real
    for attempt in range(100):
        drawn = written(left.withColumn("sur", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key, digits)).withColumn("s", F.lower("sur")), "drawn")
        first = drawn.withColumn("_rank", F.row_number().over(Window.partitionBy("kind", "s").orderBy("norm"))).filter("_rank = 1").drop("_rank")
        used = reduce(DataFrame.unionByName, [taken, *[d.select("kind", "s") for d in done]])
        won = written(first.join(used, ["kind", "s"], "left_anti"), "won")
        done.append(won)
        left = written(drawn.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm"), "lost")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done).select("kind", "norm", "sur")
    raise ValueError("a kind of entity has no more values of its format")


def _text_id(text: Column) -> Column:
    return F.sha2(text, 256)


def find_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``tid`` (digest of the text), ``pos``, ``kind``, ``entity``, ``name`` (a person's gender, given name and
    surname): once for each distinct text."""
    t = F.col(text)
    found = docs.filter(has_entities(t)).select(_text_id(t).alias("tid"), F.posexplode(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))).alias("pos", "entity"))
    found = found.groupBy("tid", "pos").agg(F.max("entity").alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    return found.withColumn("name", F.when(F.col("kind") == "person", _name_parts(F.col("entity"))))


def entity_units(entities: DataFrame) -> DataFrame:
    """``tid, pos, part, kind, norm``: the units of each entity, the genders of names resolved."""
    names = entities.filter("kind = 'person'").select("tid", "pos", "name.*").withColumn("_key", F.lower(F.coalesce("surname", "given")))
    sure = F.when(F.col("gender") != "n", F.col("gender"))
    one = lambda w: F.when(F.min(sure).over(w) == F.max(sure).over(w), F.min(sure).over(w))
    names = names.withColumn("_here", one(Window.partitionBy("tid", "_key")))
    anywhere = names.groupBy("_key").agg(F.min(sure).alias("_a"), F.max(sure).alias("_b")).filter("_a = _b").select("_key", F.col("_a").alias("_anywhere"))
    names = names.join(anywhere, "_key", "left").withColumn("_g", F.when(F.col("gender") != "n", F.col("gender")).otherwise(F.coalesce("_here", "_anywhere", F.lit("n"))))
    unit = lambda kind, norm: F.when(norm.isNotNull(), F.struct(F.lit(kind).alias("kind"), norm.alias("norm")))
    whole = lambda c: F.concat(F.col("_g"), F.lit(":"), F.lower(c))
    named = names.select("tid", "pos", F.posexplode(F.array_compact(F.array(unit("given", whole("given")), unit("surname", whole("surname"))))).alias("part", "u"))
    norm = normal_form(F.col("kind"), F.col("entity"))
    mail = F.array(unit("local", norm), unit("host", F.substring_index(norm, "@", -1)))
    other = entities.filter("kind <> 'person'").select("tid", "pos", F.posexplode(F.when(F.col("kind") == "email", mail).otherwise(F.array(F.struct("kind", norm.alias("norm"))))).alias("part", "u"))
    return named.unionByName(other).select("tid", "pos", "part", "u.kind", "u.norm")


def _bare(put: DataFrame) -> DataFrame:
    """``tid, _bare``: for each text with persons, its full names and surnames with their surrogates, longer ones first."""
    names = lambda c: F.filter(_words(F.col(c)), lambda w: ~_initial(w))
    was, new = names("entity"), names("new")
    pair = lambda a, b: F.struct(F.length(a).alias("size"), a.alias("was"), b.alias("new"))
    full = F.when(F.size(was) == 2, pair(F.array_join(was, " "), F.array_join(new, " ")))
    last = pair(F.element_at(was, -1), F.element_at(new, -1))
    each = put.filter("kind = 'person'").select("tid", "pos", F.explode(F.array_compact(F.array(full, last))).alias("p"))
    each = each.groupBy("tid", "p.size", "p.was").agg(F.min_by("p.new", "pos").alias("new"))
    return each.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("size", "was", "new")), asc=False).alias("_bare"))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with their columns, entities in the text replaced, and ``n_entities`` (bare names that
    repeat a person of the text are replaced and not counted).

    Null texts stay null; texts without entities stay as they are. Repeated rows are treated alike. The
    same key gives the same surrogates for the same set of entities. A column ``n_entities`` of the input
    is replaced.
    """
    docs = docs.drop("n_entities")
    names = docs.columns
    t = F.col(text)
    entities = written(find_entities(docs, text), "entities")
    units = written(entity_units(entities), "units")
    drawn = surrogates(units, key)
    sur = units.join(drawn, ["kind", "norm"]).groupBy("tid", "pos").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "sur"))), lambda x: x["sur"]).alias("sur"))
    put = entities.join(sur, ["tid", "pos"]).select("tid", "pos", "kind", "entity", written_as(F.col("kind"), F.col("entity"), F.col("sur"), key).alias("new"))
    put = written(put, "put")
    bare = _bare(put)
    put = put.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("_put")).join(bare, "tid", "left")
    once = lambda g, p: F.call_function("regexp_replace", g, F.concat(F.lit(r"(?<![\p{L}\d])\Q"), p["was"], F.lit(r"\E(?![\p{L}\d])")), p["new"])
    gap = lambda g: F.when(F.col("_bare").isNull(), g).otherwise(F.aggregate("_bare", g, once))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split("_text", ENTITY, -1), F.transform("_put", lambda x: x["new"]), lambda g, new: F.array(gap(g), F.coalesce(new, F.lit(""))))), "")
    clean = docs.filter(~has_entities(t)).withColumn("n_entities", F.lit(0).cast("bigint"))
    dirty = docs.filter(has_entities(t)).select(F.struct(*[docs[c] for c in names]).alias("_row"), t.alias("_text"), _text_id(t).alias("_tid")).join(put, F.col("_tid") == F.col("tid"))
    dirty = dirty.select(*[rebuilt.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in names], F.size("_put").cast("bigint").alias("n_entities"))
    return clean.unionByName(dirty)


#: The query's key. A real job passes its own secret.
QUERY_KEY = "surrogates of the query"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its entities replaced."""
    return replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).select("doc_id", "text", "n_entities")
