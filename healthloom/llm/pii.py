"""Surrogates for personal data [native].

Entities are found by one ordered pattern: e-mail addresses, secrets, IBANs, IP addresses, phone numbers, card numbers, social
security numbers and titled names. Each is replaced by a surrogate of the same type and form, made by a keyed hash:

* digits become digits, letters letters of the same case, hex stays hex; signs, lengths and titles stay;
* e-mail domains become names below example.org; card numbers keep their first digit and get a right check digit;
  IP addresses stay valid, in ranges that nobody owns; phone numbers keep their country code;
* given names become given names of the title's gender and the script (Latin, Cyrillic, Greek), surnames become surnames.

The same entity gets the same surrogate in every document (coreference): the key and the entity alone decide. Of a name each word
is an entity by itself: where one word follows a title it is the surname, of two the first is the given name. So "Mr. John Smith"
and "Dr Smith" keep a surname in common, and words of a document's titled names are replaced where they stand alone in it, too.
E-mail addresses that differ in case alone are one entity, each in its own case.

A check over all distinct entities finds surrogates that two entities share or that equal some real entity; all but the entity
of the smallest hash then move on to their next candidate, round by round, until none is left (distinctness). Candidates of later
rounds have more to vary. Entities still in conflict after ROUNDS rounds (their form has too few values) get twelve digits of
their hash added to their form.

Defined results: null stays null, empty stays empty; repeated rows are treated alike; an empty table gives an empty result;
texts are searched whole; the input's other columns stay, those named like an output (n_pii, pii_types) are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, keyed_join, without, written

ROUNDS = 8

# Titles by gender; given names by script and gender, and the beginnings and ends of surnames by script.
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Г-н", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Г-жа", "Κυρία"), "n": ("Dr", "Prof")}
NAMES = {
    "latin_m": ("Adam", "Brian", "Carl", "David", "Edgar", "Frank", "George", "Henry", "Ivan", "Jacob", "Karl", "Louis", "Martin", "Nathan", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor"),
    "latin_f": ("Alice", "Bella", "Clara", "Diana", "Emma", "Fiona", "Grace", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera"),
    "cyrillic_m": ("Алексей", "Борис", "Виктор", "Григорий", "Дмитрий", "Егор", "Иван", "Михаил", "Николай", "Павел"),
    "cyrillic_f": ("Анна", "Валентина", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"),
    "greek_m": ("Γιώργος", "Νίκος", "Πέτρος", "Σταύρος", "Ανδρέας"),
    "greek_f": ("Ελένη", "Μαρία", "Σοφία", "Αγγελική", "Κατερίνα"),
    "latin_begin": ("Ab", "Beck", "Cald", "Dal", "El", "Fisch", "Gar", "Hugh", "Ib", "Jan", "Kel", "Lam", "Mor", "Nor", "Ol", "Park", "Quin", "Ros", "Schil", "Tur"),
    "latin_end": ("bott", "er", "low", "ton", "lis", "ner", "ford", "es", "sen", "man", "berg", "worth", "ley", "wick", "dale", "strom", "ham", "field", "well", "by"),
    "cyrillic_begin": ("Бонд", "Гонч", "Ков", "Крав", "Мельн", "Савч", "Тк", "Шевч", "Черн", "Бел"),
    "cyrillic_end": ("арь", "енко", "ук", "ых", "ец", "ко", "чук", "аль", "юк", "ань"),
    "greek_begin": ("Παπ", "Σπαν", "Λασκ", "Βλαχ", "Καλ"),
    "greek_end": ("άς", "ός", "άρης", "όπουλος", "ίδης"),
}

_TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t))) + ")"
#: Types with their patterns, in order: where several match at a place the first wins.
TYPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}[A-Za-z0-9])?){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:(?:sk|pk|rk)[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|AKIA[A-Z0-9]{16}|xox[abpr]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9-])|(?<![0-9-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLE}\.? \p{{Lu}}[\p{{Ll}}'’-]{{1,40}}(?: \p{{Lu}}[\p{{Ll}}'’-]{{1,40}})?",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: One of these is in every entity: texts without any aren't matched.
_GATE = r"[0-9@]|[0-9a-fA-F]{32}|(?<![A-Za-z0-9])(?:[spr]k[-_]|gh[pousr]_|AKIA|xox[abpr]-)|" + _TITLE


def key(spark: SparkSession) -> str:
    """The key of a run, from spark.healthloom.pii.key. The invented tables of the tests may do without: theirs is no secret."""
    return spark.conf.get("spark.healthloom.pii.key", "key of the invented tables")


def type_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in TYPES.items()], F.lit("name"))


def keyed(secret: str, *parts: Column) -> Column:
    """A hash of the parts that only the holder of the key can make, as 64 hex digits."""
    inner = F.sha2(F.concat_ws("|", F.lit(f"{secret}/in"), *parts), 256)
    return F.sha2(F.concat(F.lit(f"{secret}/out|"), inner), 256)


def _number(hexes: Column, at: Column | int, width: int = 4) -> Column:
    return F.conv(F.substr(hexes, F.lit(at) if isinstance(at, int) else at, F.lit(width)), 16, 10).cast("int")


def same_form(entity: Column, stream: Column) -> Column:
    """entity with each digit and letter replaced by another of its kind; stream: hex digits, four a character."""
    # The kinds of characters that are replaced, each by its own kind.
    kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def one(ch: Column, i: Column) -> Column:
        n = _number(stream, i * 4 + 1)
        out = ch
        for kind in kinds:
            out = F.when(F.contains(F.lit(kind), ch), F.substr(F.lit(kind), n % len(kind) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _hex_form(entity: Column, stream: Column) -> Column:
    lower = F.substr(stream, F.lit(1), F.length(entity))
    return F.when(entity.rlike("[A-F]"), F.upper(lower)).otherwise(lower)


def _luhn(digits: Column) -> Column:
    """The check digit of digits (an array of int, without it)."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return (F.lit(10) - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def _card(entity: Column, stream: Column) -> Column:
    """Same grouping and first digit, with a right check digit at the end."""
    body = F.concat(F.substr(entity, F.lit(1), F.lit(1)), same_form(F.substr(entity, F.lit(2), F.length(entity) - 2), stream))
    return F.concat(body, _luhn(F.transform(F.split(F.regexp_replace(body, "[^0-9]", ""), ""), lambda d: d.cast("int"))).cast("string"))


def _pick(names: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), n % len(names) + 1)


SCRIPTS = ("latin", "cyrillic", "greek")
_END = "['’]s$|['’-]+$"


def _word(word: Column, kind: Column, stream: Column, rounds: Column) -> Column:
    """A name of the word's script: a given name by its gender, else a surname. Later rounds add another one, then syllables."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def chosen(at: int) -> Column:
        out = F.lit(None).cast("string")
        for s in SCRIPTS:
            family = F.concat(_pick(NAMES[f"{s}_begin"], _number(stream, at)), _pick(NAMES[f"{s}_end"], _number(stream, at + 4)))
            given = F.when(kind == "given_m", _pick(NAMES[f"{s}_m"], _number(stream, at))).when(kind == "given_f", _pick(NAMES[f"{s}_f"], _number(stream, at)))
            out = F.when(script == s, F.coalesce(given, family)).otherwise(out)
        return out

    syllables = F.initcap(F.translate(F.substr(stream, F.lit(17), F.lit(6)), "0123456789", "ghijklmnop"))
    return F.concat(chosen(1), F.when(rounds > 0, F.concat(F.lit("-"), chosen(9))).otherwise(""), F.when(rounds > 2, F.concat(F.lit("-"), syllables)).otherwise(""))


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^({_TITLE}\.?) ", 1)


def name_words(entity: Column) -> Column:
    """The words of a titled name, in order: structs of kind (given_m, given_f, given_n, surname), word, and end (a genitive's)."""
    title = title_of(entity)
    bare = F.regexp_replace(title, r"\.", "")
    gender = F.when(bare.isin(*TITLES["m"]), "given_m").when(bare.isin(*TITLES["f"]), "given_f").otherwise("given_n")
    words = F.split(F.substr(entity, F.length(title) + 2, F.length(entity)), " ")
    return F.transform(words, lambda w, i: F.struct(F.when((F.size(words) > 1) & (i == 0), gender).otherwise(F.lit("surname")).alias("kind"), F.regexp_replace(w, _END, "").alias("word"), F.regexp_extract(w, f"({_END})", 1).alias("end")))


def folded(entity: Column, kind: Column) -> Column:
    """What tells an entity of its kind from another: e-mail addresses by their lower case."""
    return F.when(kind == "email", F.lower(entity)).otherwise(entity)


def surrogate(entity: Column, kind: Column, secret: str, rounds: Column) -> Column:
    """The candidate of a round. Every form depends on nothing but the key, the entity, its form and the round."""
    seed = keyed(secret, kind, folded(entity, kind), rounds.cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.length(entity) / 16).cast("int")), lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")), 256))
    made = _bound(F.array_join(blocks, ""), lambda stream: _formed(entity, kind, stream, rounds))
    digits = F.translate(F.substr(seed, F.lit(1), F.lit(12)), "abcdef", "012345")
    last = F.when(kind == "email", F.concat(digits, F.lit("."), made)).otherwise(F.concat(made, F.lit("-"), digits))
    return F.when(rounds >= ROUNDS, last).otherwise(made)


def _bound(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _formed(entity: Column, kind: Column, stream: Column, rounds: Column) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.concat(same_form(local, stream), F.lit("@"), same_form(F.regexp_replace(domain, r"\.[^.]*$", ""), F.substr(stream, F.length(local) * 4 + 1, F.length(stream))), F.lit(".example.org"))
    # Private addresses, in later rounds those that are reserved for ever.
    first = F.when(rounds > 1, (_number(stream, 13) % 15 + 240).cast("string")).otherwise("10")
    ip = F.concat(first, F.lit("."), (_number(stream, 1) % 256).cast("string"), F.lit("."), (_number(stream, 5) % 256).cast("string"), F.lit("."), (_number(stream, 9) % 254 + 1).cast("string"))
    prefix = F.regexp_extract(entity, r"^(sk[-_]|pk[-_]|rk[-_]|gh[pousr]_|AKIA|xox[abpr]-)", 1)
    secret_form = F.when(prefix == "", _hex_form(entity, stream)).otherwise(F.concat(prefix, same_form(F.substr(entity, F.length(prefix) + 1, F.length(entity)), stream)))
    # A number's country code and its first digit stay.
    lead = F.regexp_extract(entity, r"^(\+[0-9]{1,3}[ .-]?\(?|\(?)", 1)
    phone = F.concat(lead, same_form(F.substr(entity, F.length(lead) + 1, F.length(entity)), stream))
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), same_form(F.substr(entity, F.lit(3), F.length(entity)), stream))
    ssn = F.concat(F.lit("9"), same_form(F.substr(entity, F.lit(2), F.length(entity)), stream))
    forms = {"email": email, "ip": ip, "secret": secret_form, "iban": iban, "ssn": ssn, "card": _card(entity, stream), "phone": phone}
    return reduce(lambda out, k: F.when(kind == k, forms[k]).otherwise(out), forms, _word(entity, kind, stream, rounds))


def atoms(hit: Column) -> Column:
    """The entities in a found place, structs of kind and entity: the words of a name, else the place's text as it is told apart."""
    kind = type_of(hit)
    words = F.transform(name_words(hit), lambda w: F.struct(w["kind"].alias("kind"), w["word"].alias("entity")))
    return F.when(kind == "name", words).otherwise(F.array(F.struct(kind.alias("kind"), folded(hit, kind).alias("entity"))))


def conflicts(found: DataFrame, secret: str) -> DataFrame:
    """kind, entity, rounds of the entities whose first candidate another entity has or is: a few, by hash of the pair.

    found: distinct (kind, entity). Each round the losers of a shared surrogate, and those whose surrogate is a real entity,
    take the next candidate; winners of earlier rounds keep theirs. Many entities may share a candidate: they are counted before
    any shuffle, and what is contested comes back to them by a broadcast or a salted join.
    """
    candidate = lambda rows, r: rows.withColumn("rounds", F.lit(r)).withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), secret, F.lit(r)))
    now = first = written(candidate(found.select("kind", "entity"), 0), "candidates")
    known = found.select(F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    moved = None
    for r in range(1, ROUNDS + 1):
        held = now.groupBy("surrogate").agg(F.count("*").alias("n"), F.min(F.struct("rounds", F.sha2(F.concat("kind", "entity"), 256), "kind", "entity")).alias("w"))
        contested = held.join(known, "surrogate", "left").where("n > 1 OR real").select("surrogate", F.when(F.col("real").isNull(), F.struct("w.kind", "w.entity")).alias("winner"))
        contested = written(contested, "contested")
        lost = F.col("winner").isNull() | (F.col("winner") != F.struct("kind", "entity"))
        losers = written(keyed_join(now, contested, "surrogate", "entity").where(lost).select("kind", "entity"), "losers")
        if not losers.head(1):
            break
        now = written(now.join(losers, ["kind", "entity"], "left_anti").select("kind", "entity", "rounds", "surrogate").unionByName(candidate(losers, r)), "round")
        moved = now.where("rounds > 0")
    none = first.where("false") if moved is None else moved
    return none.select("kind", "entity", "rounds")


def replace(docs: DataFrame, secret: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with surrogates in text, n_pii (places found) and pii_types (sorted, comma-joined).

    The texts are read twice and shuffled only if a conflict reaches them: first for the distinct entities, which are checked
    against each other; then every text makes its own surrogates again, which the key and the entity alone decide. The
    entities that moved to a later candidate are few; they come as a map, broadcast when counted to be small, else through a
    join of (document, entity) rows.
    """
    docs = without(docs, "n_pii", "pii_types")
    taken = {c.lower() for c in docs.columns}
    hits_name, later_name, one_name, row_name = (free(n, taken) for n in ("__hits", "__later", "__one", "__row"))
    t = F.col(f"`{text}`")
    hits = F.when(t.rlike(_GATE), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    places = docs.select(F.explode(hits).alias("hit")).distinct()
    entities = written(places.select(F.explode(atoms(F.col("hit"))).alias("a")).select("a.kind", "a.entity").distinct(), "entities")
    moved = written(conflicts(entities, secret).select(_key(F.col("kind"), F.col("entity")).alias("entity"), "rounds"), "moved")
    n = moved.count()
    marked = docs.withColumn(hits_name, hits)
    if n:
        if n <= MOST_MOVED:
            one = moved.agg(F.map_from_entries(F.collect_list(F.struct("entity", "rounds"))).alias(later_name)).withColumn(one_name, F.lit(1))
            marked = marked.withColumn(one_name, F.lit(1)).join(F.broadcast(one), one_name, "left")
        else:
            marked = _with_own_rounds(marked, moved, hits_name, later_name, row_name)

    def made(entity: Column, kind: Column) -> Column:
        rounds = F.coalesce(F.element_at(F.col(later_name), _key(kind, folded(entity, kind))), F.lit(0)) if n else F.lit(0)
        return surrogate(entity, kind, secret, rounds)

    def swapped(hit: Column) -> Column:
        words = F.transform(name_words(hit), lambda w: F.concat(made(w["word"], w["kind"]), w["end"]))
        return _bound(type_of(hit), lambda kind: F.when(kind == "name", F.concat(title_of(hit), F.lit(" "), F.array_join(words, " "))).otherwise(made(hit, kind)))

    held = F.col(hits_name)
    named = F.flatten(F.transform(F.filter(held, lambda h: type_of(h) == "name"), name_words))
    # Of a word that is found as both, the surname counts: kinds sort before it. Each comes once, with its surrogate.
    own = F.map_from_entries(F.transform(F.array_distinct(F.transform(named, lambda w: w["word"])), lambda x: F.struct(x, F.array_max(F.transform(F.filter(named, lambda w: w["word"] == x), lambda w: w["kind"])))))
    alone = F.transform(F.map_entries(own), lambda w: F.struct(F.concat(F.lit(r"(?<![\p{L}-])"), w["key"], F.lit(r"(?![\p{L}-])")).alias("word"), made(w["key"], w["value"]).alias("new")))

    def freed(parts: Column) -> Column:
        """The stretches between the places, without the names that stand alone in them."""
        return _bound(alone, lambda names: F.transform(parts, lambda p: F.aggregate(names, p, lambda acc, w: F.regexp_replace(acc, w["word"], w["new"]))))

    between = F.split(t, PATTERN, -1)
    between = F.when(F.exists(held, lambda h: type_of(h) == "name"), freed(between)).otherwise(between)
    joined = F.array_join(F.zip_with(between, F.transform(held, swapped), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    some = F.size(held) > 0
    kinds = F.array_join(F.sort_array(F.array_distinct(F.transform(held, type_of))), ",")
    names = [F.when(some, joined).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*names, F.when(some, F.size(held)).otherwise(F.lit(0)).alias("n_pii"), F.when(some, kinds).otherwise(F.lit("")).alias("pii_types"))


def _key(kind: Column, entity: Column) -> Column:
    return F.concat(kind, F.lit("|"), entity)


#: Entities in conflict that are broadcast as one map; beyond, they are joined.
MOST_MOVED = 20_000


def _with_own_rounds(marked: DataFrame, moved: DataFrame, hits: str, later: str, row: str) -> DataFrame:
    """marked with a map for just the entities of each text, through a join of the distinct entities of each row."""
    keyed_rows = written(marked.withColumn(row, F.expr("uuid()")), "rows")
    own = F.array_distinct(F.transform(F.flatten(F.transform(hits, atoms)), lambda a: _key(a["kind"], a["entity"])))
    pairs = keyed_rows.select(row, F.explode(own).alias("entity")).join(moved.select("entity", "rounds"), "entity")
    maps = pairs.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("entity", "rounds"))).alias(later))
    return keyed_rows.join(maps, row, "left").drop(row)


def stage(docs: DataFrame, secret: str) -> DataFrame:
    return replace(docs, secret).select(*docs.columns)
