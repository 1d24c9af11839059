"""Personal data: detection and keyed surrogates, by DataFrame and SQL functions alone.

Kinds: EMAIL, IP, IP6 (all eight groups), SSN, PHONE, CARD (13 to 19 digits), KEY (access keys and assigned secrets) and PERSON (all
capitalised words behind a title, and each of them wherever it recurs with a capital in the same text). An entity is its kind and normal form (lower-case; digits alone for numbers; a name is each of its
words), so spellings of one entity share a surrogate. A surrogate replaces letters by letters and digits by digits
at their places: vowels by vowels and other letters by other letters of the same script and case (of scripts other than Latin, Cyrillic and
Greek, letters by their neighbours in the code, so of one script and case too), and signs,
lengths, the country code, the mail's top domain and a password's label and quotes stay. Numbers that pass the Luhn check get
surrogates that pass it; IP octets stay octets; titles and a name's last letter stay, and with them its gender.

Surrogates come from SHA-256 of key, kind, normal form and draw number. Drawing goes on for entities whose
surrogate another entity has (the smaller keeps it) or that is itself an entity of the corpus, so distinct stays
distinct and no surrogate is a real value. After every ``WIDEN`` draws in vain a format is nearly used up, and the
surrogate gets a character more, so drawing ends for any number of entities (but for addresses of four three-digit octets, of which there
are a hundred million).

Searches are bounded: no mail address with over 64 characters before the @ is found, no name word of over 60 letters;
of a secret the first 4,096 characters are replaced; names have at most 50 words. So time is linear in a text.

Cases: null texts stay null; texts without entities stay as they are, to the byte; repeated rows get equal
results; null ids are no obstacle (rows join by their text's hash); an empty table gives an empty result; all other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickline.llm.common import stored

TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Г-н|Г-жа|Κύριος|Κυρία"
#: Repeats are bounded, so that no text makes the search deep or slow: 64 characters before the @, 60 labels of 63.
EMAIL = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,60}[A-Za-z]{2,63}"
IP6 = r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
CARD = r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\-]?\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w])|(?<![\w+])\+\d{8,15}(?!\w)"
COUNTRY = r"^\+(?:1(?=\d{10}$)|\d{1,3}[ .\-]|\d{1,3}(?=\()|\d{2}(?=\d{7,}$))"
#: A quote, escaped or not, that may close a label or open its value.
QUOTE = r"(?:\\?[\"'`“”„‘’«»])?"
#: What may stand between a secret's label and its value; a value needs a letter or digit, else it had no surrogate.
ASSIGN = rf"{QUOTE}[ \t]*\s?[=:][ \t]*\s?{QUOTE}"
KEY = rf"\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b|\b(?i:password|passwd|pwd|secret|token|api[_\-]?key){ASSIGN}(?=[_\-]{{0,99}}[A-Za-z0-9])[A-Za-z0-9_\-]{{6,4096}}|\b(?:ghp|gho|sk|pk|xox[bp])[_\-][A-Za-z0-9_\-]{{16,4096}}"
TITLE = rf"\b(?:{TITLES})\b\.?"
#: A capitalised word that is no title; a possessive s is left out.
_TAIL = r"(?:['’\-](?!s\b)\p{L}{1,60}+)"
WORD = rf"(?!(?:{TITLES})\b)\p{{Lu}}(?:\p{{L}}{{1,60}}+{_TAIL}{{0,6}}|{_TAIL}{{1,6}})(?!\p{{L}})"
NAME = rf"{TITLE}(?: {TITLE}){{0,9}} {WORD}(?: {WORD}){{0,49}}"
ANY = "|".join((EMAIL, KEY, IP6, IP, SSN, CARD, PHONE, NAME))
#: Cheap signs that a text may hold an entity at all.
HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|api.?key)|\b(?:AKIA|ASIA)[A-Z]|\b(?:ghp|gho|sk|pk|xox[bp])[_\-]|\b(?:{TITLES})\b"
#: Kinds whose signs stay and whose digits alone count.
NUMBERS = ("CARD", "PHONE", "SSN")
#: After so many draws in vain a format is taken to be nearly full, and the surrogate gets a character more.
WIDEN = 12
VOWELS, REST = "aeiou", "bcdfghjklmnpqrstvwxyz"
#: Letters by script: vowels, others.
ALPHABETS = (("[a-z]", VOWELS, REST), (r"\p{IsCyrillic}", "аеёиоуыэюя", "бвгджзклмнпрстфхцчш"), (r"\p{IsGreek}", "αεηιουω", "βγδζθκλμνξπρστφχψ"))


def kind_of(m: Column) -> Column:
    return (
        F.when(m.rlike(f"^(?:{EMAIL})$"), "EMAIL").when(m.rlike(f"^(?:{KEY})$"), "KEY").when(m.rlike(f"^(?:{IP})$"), "IP")
        .when(m.rlike(f"^(?:{IP6})$"), "IP6").when(m.rlike(f"^(?:{SSN})$"), "SSN").when(m.rlike(f"^(?:{CARD})$"), "CARD").when(m.rlike(f"^(?:{NAME}|{WORD})$"), "PERSON").otherwise("PHONE")
    )


def _words(m: Column) -> Column:
    """A name's words, without the titles before them."""
    return F.split(F.regexp_replace(m, rf"^(?:{TITLE} )+", ""), " ")


def _pattern(text: Column) -> Column:
    """What to look for in a text that holds a title: every kind, and its own names' words wherever they recur with a capital."""
    names = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1)), _words)))
    again = F.concat(F.lit(r"|(?<!\p{L})(?=\p{Lu})(?iu:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    return F.concat(F.lit(f"(?:{ANY})"), F.when(F.size(names) > 0, again).otherwise(""))


def _parts(kind: Column, m: Column) -> Column:
    """What of a match is replaced: array of the value itself or, for names, of each word behind the title."""
    value = F.when(kind == "KEY", F.regexp_replace(m, rf"^[^=:]*[=:][ \t]*\s?{QUOTE}", "")).when(kind == "PHONE", F.regexp_replace(m, COUNTRY, "")).otherwise(m)
    return F.when(kind == "PERSON", _words(m)).otherwise(F.array(value))


def _norm(kind: Column, part: Column) -> Column:
    digits = F.regexp_replace(part, r"\D", "")
    return F.when(kind.isin(*NUMBERS), digits).when(kind == "KEY", part).otherwise(F.lower(part))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit undoubled."""
    d = F.reverse(F.split(digits, ""))
    own = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.coalesce(own, F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x)


def _pick(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))


def _neighbour(c: Column, byte: Column) -> Column:
    """A letter among the 32 code points about a small or caseless letter that has case as it has; a letter without neighbours stays.

    For letters of scripts that ``ALPHABETS`` doesn't list: scripts fill such ranges, so the script is the letter's own.
    """
    code = F.ascii(c)
    letter = lambda k: F.decode(F.unhex(F.lpad(F.hex((code - code % 32 + k).cast("long")), 8, "0")), "UTF-32")
    cased = F.upper(c) != c
    like = lambda x: x.rlike(r"^\p{L}$") & (F.lower(x) == x) & ((F.upper(x) != x) == cased) & (F.lower(F.upper(x)) == x) & (F.length(F.upper(x)) == 1)
    near = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), like)
    return F.when(F.size(near) > 1, F.element_at(near, byte % F.size(near) + 1)).otherwise(c)


def widened(kind: Column, norm: Column, times: Column) -> Column:
    """A longer format of the same kind: octets get a leading digit, numbers and keys an end, others a beginning."""
    octets = F.when(times > 1, F.regexp_replace(F.regexp_replace(norm, r"\b(\d{1,2})\b", "1$1"), r"\b(\d{1,2})\b", "1$1")).otherwise(F.regexp_replace(norm, r"\b(\d{1,2})\b", "1$1"))
    longer = F.when(kind == "IP", octets).when(kind.isin("KEY", *NUMBERS), F.concat(norm, F.repeat(F.right(norm, F.lit(1)), times)))
    return F.when(times > 0, longer.otherwise(F.concat(F.repeat(F.left(norm, F.lit(1)), times), norm))).otherwise(norm)


def draw(kind: Column, norm: Column, n: Column, key: str) -> Column:
    """The n-th candidate surrogate of a normal form: each character from its own class, the length the same for the first draws."""
    seed, valid = F.concat_ws("\x1f", F.lit(key), kind, norm, n.cast("string")), luhn_sum(norm) % 10 == 0
    norm = widened(kind, norm, F.floor(n / WIDEN).cast("int"))
    chars = F.filter(F.split(norm, ""), lambda c: c != "")
    # 32 pseudorandom bytes a digest; as many digests as the value needs
    pool = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 32).cast("int")), lambda k: F.sha2(F.concat_ws("\x1f", seed, k.cast("string")), 256)), "")
    size = F.length(norm)
    top = F.length(F.regexp_extract(norm, r"\.[a-z]+$", 0))

    def one(c: Column, i: Column) -> Column:
        byte = F.conv(F.substring(pool, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        first_octet_digit = (i == 0) | (F.element_at(chars, F.greatest(i, F.lit(1))) == ".")
        short_octet = F.substring(norm, i + 2, F.lit(2)).rlike(r"^\d\d")
        out = F.when((kind == "EMAIL") & (i >= size - top), c)
        out = out.when((kind == "PERSON") & (i == size - 1) & (size > 2), c)
        out = out.when((kind == "KEY") & (i < 4) & norm.rlike("^(?:AKIA|ASIA)"), c)
        out = out.when((kind == "IP") & c.rlike(r"\d"), F.when(first_octet_digit & short_octet, "1").when(first_octet_digit, _pick("123456789", byte)).otherwise(_pick("0123456789", byte)))
        out = out.when((kind == "IP6") & c.rlike("[a-f]"), _pick("abcdef", byte))
        out = out.when(kind.isin(*NUMBERS) & (i == 0), F.when(c == "0", c).otherwise(F.when(kind == "CARD", c).otherwise(_pick("23456789", byte))))
        out = out.when(c.rlike(r"\d"), _pick("0123456789", byte))
        for script, vowels, rest in ALPHABETS:
            out = out.when(c.rlike(f"^{script}$"), F.when(c.rlike(f"[{vowels}]"), _pick(vowels, byte)).otherwise(_pick(rest, byte)))
        out = out.when(c.rlike("^[A-Z]$"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", byte))
        out = out.when(c.rlike(r"^\p{IsLatin}$"), _pick(VOWELS + REST, byte))
        return out.when(c.rlike(r"^\p{L}$"), _neighbour(c, byte)).otherwise(c)

    made = F.array_join(F.transform(chars, one), "")
    body = F.substring(made, F.lit(1), size - 1)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when((kind == "CARD") & valid, F.concat(body, check.cast("string"))).otherwise(made)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm and surrogate of distinct entities (kind, norm): pairwise distinct in a kind, none of them an entity.

    Each turn draws for what is still open and stores the outcome; collisions are rare, so turns are few.
    """
    every = stored(entities.distinct(), "pii-entities")
    pending, done, turn = every, None, 0
    while True:
        drawn = stored(pending.select("kind", "norm", draw(F.col("kind"), F.col("norm"), F.lit(turn), key).alias("surrogate")), "pii-drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        fresh = first.join(every.withColumnRenamed("norm", "surrogate"), ["kind", "surrogate"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        fresh = fresh.select("kind", "norm", "surrogate")
        done = stored(fresh if done is None else done.union(fresh), "pii-done")
        pending = stored(every.join(done, ["kind", "norm"], "left_anti"), "pii-open")
        turn += 1
        if pending.isEmpty():
            return done


def render(part: Column, norm: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the spelling of the part: its signs and its letters' case."""
    chars = F.split(part, "")
    kept = F.when(kind.isin(*NUMBERS), r"\d").otherwise(".")
    last = F.when(kept == ".", F.length(part)).otherwise(F.length(F.regexp_replace(part, r"\D", "")))
    place = F.transform(chars, lambda c, i: F.when(kept == ".", i + 1).otherwise(F.length(F.regexp_replace(F.substring(part, F.lit(1), i + 1), r"\D", ""))))

    def one(c: Column, i: Column) -> Column:
        at = F.element_at(place, i + 1)
        new = F.substring(surrogate, at, F.when(at == last, 1_000_000).otherwise(1))  # a wider format ends where the part does
        takes = (kept == ".") | c.rlike(r"\d")
        return F.when(takes, F.when((F.upper(c) == c) & (F.lower(c) != c), F.upper(new)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def pseudonymize(docs: DataFrame, key: str = "surrogate-key-1") -> tuple[DataFrame, DataFrame]:
    """The rows with every entity of their text replaced, and a table (h, h2, n, kinds) of what each text held.

    Only texts with entities are shuffled, once; the others pass by.
    """
    may = F.col("text").rlike(HINT)
    cols = docs.columns
    titled = F.col("text").rlike(NAME)  # these are few, and only they have a pattern of their own
    found = lambda pattern: F.regexp_extract_all("text", pattern, F.lit(0))
    marked = docs.select(*cols, F.when(may & titled, found(_pattern(F.col("text")))).when(may, found(F.lit(ANY))).alias("_m"))
    has = F.coalesce(F.size("_m") > 0, F.lit(False))
    # texts are told apart by two hashes; a shared one would only share maps, which hold no wrong entry
    rows = marked.filter(has).select(F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("h2"), "_m")
    found = rows.select("h", "h2", F.explode(F.array_distinct("_m")).alias("m")).distinct().select("*", kind_of(F.col("m")).alias("kind"))
    found = stored(found, "pii-found")
    spelled = found.select("kind", "m").distinct()
    parts = spelled.select("kind", "m", F.posexplode(_parts(F.col("kind"), F.col("m"))).alias("at", "part"))
    parts = parts.select("*", _norm(F.col("kind"), F.col("part")).alias("norm"))
    chosen = surrogates(parts.select("kind", "norm"), key)
    shown = parts.join(chosen, ["kind", "norm"]).select("kind", "m", "at", "part", render(F.col("part"), F.col("norm"), F.col("surrogate"), F.col("kind")).alias("new"))
    whole = shown.groupBy("kind", "m").agg(F.array_sort(F.collect_list(F.struct("at", "part", "new"))).alias("p"))
    whole = whole.select("kind", "m", F.concat(F.expr("left(m, length(m) - length(array_join(transform(p, x -> x.part), ' ')))"), F.array_join(F.transform("p", lambda x: x["new"]), " ")).alias("new"))
    maps = found.join(whole, ["kind", "m"]).groupBy("h", "h2").agg(F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias("_map"), F.sort_array(F.collect_set("kind")).alias("_kinds"))
    maps = stored(maps, "pii-maps")
    own = marked.filter(has).withColumns({"_h": F.xxhash64("text"), "_h2": F.crc32(F.col("text").cast("binary"))})
    maps = maps.withColumnsRenamed({"h": "_mh", "h2": "_mh2"})
    joined = own.join(maps, (F.col("_h") == F.col("_mh")) & (F.col("_h2") == F.col("_mh2")))
    between = F.when(titled, F.split("text", _pattern(F.col("text")), -1)).otherwise(F.split("text", f"(?:{ANY})", -1))
    text = F.array_join(F.transform(F.arrays_zip(between.alias("b"), F.col("_m").alias("m")), lambda x: F.concat(x["b"], F.coalesce(F.element_at("_map", x["m"]), F.lit("")))), "")
    joined = joined.withColumn("_text", text)
    new = {"text": F.col("_text")}
    if "n_chars" in cols:
        new["n_chars"] = F.length("_text").cast(dict(docs.dtypes)["n_chars"])
    clean = marked.filter(~has)
    counted = joined.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in cols], F.size("_m").alias("_n"), F.col("_kinds"))
    return counted.unionByName(clean.select(*[F.col(f"`{c}`") for c in cols], F.lit(0).alias("_n"), F.array().cast("array<string>").alias("_kinds"))), chosen


def surrogate_documents(docs: DataFrame, key: str = "surrogate-key-1") -> DataFrame:
    """The documents, all columns, with surrogates in their texts."""
    return pseudonymize(docs, key)[0].select(docs.columns)


def surrogate_texts(docs: DataFrame, key: str = "surrogate-key-1") -> DataFrame:
    """doc_id, n_entities, kinds (sorted, comma-joined) and the new text of every row."""
    out, _ = pseudonymize(docs.select("doc_id", "text"), key)
    return out.select("doc_id", F.col("_n").cast("long").alias("n_entities"), F.array_join("_kinds", ",").alias("kinds"), "text")
