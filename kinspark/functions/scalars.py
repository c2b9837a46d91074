"""Scalar functions: hashes, blurred literals, stems, masks, names, magnitudes."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash16(c: Column) -> Column:
    """First 16 hex digits of SHA-256: the identity of a record's content."""
    return F.substring(F.sha2(c, 256), 1, 16)


def hash8(c: Column) -> Column:
    """First 8 hex digits of SHA-1: short labels."""
    return F.substring(F.sha1(c), 1, 8)


def squeeze(c: Column) -> Column:
    """Lower case, runs of ASCII blanks to one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[ \\t\\n\\r\\f]+", " "))


def tokens(c: Column, least: int = 3) -> Column:
    """ASCII word tokens of ``least`` characters or more, lower case, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def token_set(c: Column, least: int = 3) -> Column:
    return F.array_sort(F.array_distinct(tokens(c, least)))


def shingles(words: Column, n: int) -> Column:
    """Distinct n-grams of an array of words; none where there are fewer words."""
    m = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), m)  # no lambda refers to the words themselves, which it would evaluate anew for each gram
    for j in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(j + 1), m), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.array_distinct(grams)


def magnitude(c: Column) -> Column:
    """Order of magnitude floor(log10(|x| + 1)); 0 for 0."""
    return F.floor(F.log10(F.abs(c) + 1)).cast("long")


# The shapes of volatile strings and their tokens.
VOLATILE_SEMVER = r"^v?[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"
VOLATILE_ISO8601 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"
VOLATILE_HEX_DIGEST = r"^[0-9a-fA-F]{16,64}$"


def volatile_token(c: Column) -> Column:
    """The class of a volatile string: version, timestamp, or hex digest with its length; null for all others."""
    return (
        F.when(c.rlike(VOLATILE_SEMVER), F.lit("__VOLATILE_SEMVER__"))
        .when(c.rlike(VOLATILE_ISO8601), F.lit("__VOLATILE_ISO8601__"))
        .when(c.rlike(VOLATILE_HEX_DIGEST), F.concat(F.lit("__VOLATILE_HEX_"), F.length(c).cast("string"), F.lit("__")))
    )


def blur_string(c: Column) -> Column:
    """Volatile strings become their class, others their length."""
    return F.coalesce(volatile_token(c), F.concat(F.lit("__STR_"), F.length(c).cast("string"), F.lit("__")))


def quoted(c: Column) -> Column:
    """A string as a JSON literal."""
    return F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)


def literal_token(kind: Column, value: Column, keep: Column) -> Column:
    """What a literal adds to a structural hash: kinds string, number, bigint, regex (value pattern/flags) and template; ``keep`` leaves the value."""
    number = value.cast("double")
    blurred_number = F.when(number == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(number) + 1))).cast("long").cast("string")
    return (
        F.when(kind == "string", F.concat(F.lit("S="), F.when(keep, quoted(value)).otherwise(blur_string(value))))
        .when(kind == "number", F.concat(F.lit("N="), F.when(keep, value).otherwise(blurred_number)))
        .when(kind == "bigint", F.concat(F.lit("B="), F.when(keep, value).otherwise(F.lit("0"))))
        .when(kind == "regex", F.concat(F.lit("R="), value))
        .when(kind == "template", F.concat(F.lit("Q="), F.when(keep, quoted(value)).otherwise(F.coalesce(volatile_token(value), F.length(value).cast("string")))))
    )


def kebab(c: Column) -> Column:
    """camelCase, acronyms or words to kebab-case."""
    broken = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.regexp_replace(F.regexp_replace(F.lower(broken), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def camel(c: Column) -> Column:
    """Words to camelCase."""
    parts = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda p: p != "")
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, 2, 1000))


def singular(c: Column) -> Column:
    return (
        F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y")).when(c.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(c, "es$", "")).when(c.rlike("[^s]s$"), F.regexp_replace(c, "s$", "")).otherwise(c)
    )


# The words that the conflict ladder appends, in its order, and those that stems lose besides them.
DECORATION_WORDS = ("Val", "Var", "Ref", "Item", "Data", "Result", "Value")
STRIP_ONLY_WORDS = ("Instance", "Obj")
LADDER_ONLY_WORDS = ("Result",)
DECORATION_SUFFIX = "(?:" + "|".join([*(w for w in DECORATION_WORDS if w not in LADDER_ONLY_WORDS), *STRIP_ONLY_WORDS]) + r"|_?[0-9]+)+$"
# Names that must not become stems, number tokens that are part of real names, and leading words that are none.
BAD_STEM = r"(?i)^(no[-_]?ops?\w*|doNothing\w*|silent[-_]?noops?\w*|empty(function|callback|operation|handler)s?\d*|idle[-_]?operation\d*|initializeModule\d+|placeholder\w*|_+\d*|reactLib\d+|\w+Val\d*)$"
KNOWN_NUMBER_TOKENS = ("8", "16", "32", "64", "128", "256", "512", "1024")
LEADING_STOPWORD = r"^(and|or|but|nor|the|an|a)(?=[A-Z0-9]|$)"


def name_stem(c: Column) -> Column:
    """A name without the decorations that naming adds, lower case; empty when all of it is decoration."""
    return F.lower(F.regexp_replace(c, DECORATION_SUFFIX, ""))


def has_minted_number(c: Column) -> Column:
    """A run of two or more digits that is no known unit: a counter, not a name."""
    known = F.array(*[F.lit(x) for x in KNOWN_NUMBER_TOKENS])
    return F.exists(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda run: (F.length(run) >= 2) & ~F.array_contains(known, run))


def is_rejected_stem(c: Column) -> Column:
    """Names that must never become the stem of a file or folder."""
    return c.rlike(BAD_STEM) | has_minted_number(c) | c.rlike(LEADING_STOPWORD)


def carries_no_content(statement: Column) -> Column:
    """A declaration without a single initial value: its masked form is only a shape."""
    name = r"[A-Za-z_$][A-Za-z0-9_$]*"
    return statement.rlike(rf"^\s*(var|let)\s+{name}(\s*,\s*{name})*\s*;?\s*$")


def mask_words(c: Column) -> Column:
    """Every run of word characters as one underscore: the shape of a line."""
    return F.regexp_replace(c, "[A-Za-z0-9_]+", "_")


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def set_key(c: Column) -> Column:
    """Canonical key of a set of strings."""
    return F.array_join(F.array_sort(F.array_distinct(c)), "|")


def canonical_json(m: Column) -> Column:
    """A map as JSON with its keys in order, whatever order it was built in."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def canonical_json_text(body: Column) -> Column:
    """JSON of any depth with the keys of every object in order and no blanks; null where it does not parse."""
    import json

    @F.pandas_udf("string")
    def canonical(bodies: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return bodies.map(one)

    return canonical(body)


def leaf_paths(body: Column) -> Column:
    """Paths of all leaves of a JSON value, sorted: keys joined by dots, places in lists as [i]; an empty object or list is a leaf. Null where it does not parse."""
    import json

    def walk(x: object, path: str) -> list[str]:
        if isinstance(x, dict) and x:
            return [p for k, v in x.items() for p in walk(v, f"{path}.{k}" if path else k)]
        if isinstance(x, list) and x:
            return [p for i, v in enumerate(x) for p in walk(v, f"{path}[{i}]")]
        return [path]

    @F.pandas_udf("array<string>")
    def leaves(bodies: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str] | None:
            try:
                return None if x is None else sorted(walk(json.loads(x), ""))
            except ValueError:
                return None

        return bodies.map(one)

    return leaves(body)


def conflict_free(base: Column, used: Column) -> Column:
    """The first free name of: base, base with each decoration word, base2 .. base999, baseVal2, baseVal3 and so on."""

    def counted(stem: Column, first: int, last: Column) -> Column:
        return F.transform(F.sequence(F.lit(first), last), lambda i: F.concat(stem, i.cast("string")))

    def free(ladder: Column) -> Column:
        return F.get(F.array_except(ladder, used), F.lit(0))

    words = F.array(base, *[F.concat(base, F.lit(w)) for w in DECORATION_WORDS])
    return F.coalesce(free(words), free(counted(base, 2, F.lit(999))), free(counted(F.concat(base, F.lit("Val")), 2, F.size(used) + 3)))


def changed_line_share(fresh: Column, prior: Column) -> Column:
    """Lines of the fresh text that the prior one lacks, over the lines of the fresh one (1 at least)."""
    lines, old = F.split(fresh, "\n"), F.split(prior, "\n")
    return F.size(F.filter(lines, lambda x: ~F.array_contains(old, x))) / F.greatest(F.size(lines), F.lit(1))


def edited_line_counts(prior: Column, fresh: Column) -> Column:
    """(removed, added): lines of either text beyond those it shares with the other, repeats counted."""

    def beyond(x: Column, y: Column) -> Column:
        mine, other = F.split(x, "\n"), F.split(y, "\n")
        over = F.transform(F.array_distinct(mine), lambda v: F.greatest(F.size(F.filter(mine, lambda z: z == v)) - F.size(F.filter(other, lambda z: z == v)), F.lit(0)))
        return F.aggregate(over, F.lit(0).cast("long"), lambda acc, n: acc + n)

    return F.struct(beyond(prior, fresh).alias("removed"), beyond(fresh, prior).alias("added"))


def relative_import(source: Column, target: Column) -> Column:
    """The path that leads from one file's folder to another file: ``./`` in its folder or below, else one ``../`` for each folder to leave."""
    a, b = F.split(F.regexp_replace(source, "[^/]*$", ""), "/"), F.split(target, "/")
    up = F.filter(a, lambda x: x != "")
    width = F.least(F.size(up), F.size(b) - 1)
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda i: (i <= width) & (F.array_join(F.slice(up, F.lit(1), i), "/") == F.array_join(F.slice(b, F.lit(1), i), "/"))))
    climbs = F.size(up) - same
    rest = F.array_join(F.slice(b, same + 1, F.size(b) - same), "/")
    return F.concat(F.when(climbs == 0, F.lit("./")).otherwise(F.repeat(F.lit("../"), climbs)), rest)


def mask_name(text: Column, name: Column) -> Column:
    """A text with its own name, as a whole word, blanked."""
    return F.regexp_replace(text, F.concat(F.lit("(?<![A-Za-z0-9_$])"), escape_regex(name), F.lit("(?![A-Za-z0-9_$])")), F.lit("_"))
