"""Porter's stemmer as rules over a table of words, for Spark and as SQL.

A rule is a suffix, what replaces it, and a condition on what stands before it;
the longest suffix of a step decides, whether its condition holds or not. The
measure of a stem, how often vowels are followed by consonants, is a pattern.
Each step is a projection of its own, so a word's form is made once a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published rules, with the later corrections that the common ROUGE package uses.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Conditions: a measure above 0, above 1, exactly 1; a vowel; an end in consonant, vowel, consonant; before y.
SOME, MORE, ONE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$"
VOWEL, SHORT, BEFORE_Y = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$", "^.+[^aeiouy]$"
ANY = "^"
IRREGULAR = {
    "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_1A = [("sses", "ss", ANY), ("ies", "ie", "^.$"), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY)]
STEP_1B = [("ied", "ie", "^.$"), ("ied", "i", ANY), ("eed", "ee", SOME), ("ed", "*", VOWEL), ("ing", "*", VOWEL)]
#: What step 1b tidies where it took ed or ing.
DOUBLED = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"
STEP_1C = [("y", "i", BEFORE_Y)]
STEP_2 = [(a, b, SOME) for a, b in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)] + [("logi", "log", f"^({_C})?{_V}{_C}|^({_C})?{_V}$")]
STEP_3 = [(a, b, SOME) for a, b in (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))]
STEP_4 = [(a, "", MORE) for a in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")] + [("sion", "s", f"{MORE}|{SOME}{_V}$"), ("tion", "t", f"{MORE}|{SOME}{_V}$")]
#: Steps in order; the last two look at the whole word.
STEPS = [STEP_1A, STEP_1B, STEP_1C, STEP_2, STEP_3, STEP_4]


def _cases(rules: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str]]]]:
    """Rules by suffix, the longest first: (suffix, [(replacement, condition)])."""
    by: dict[str, list[tuple[str, str]]] = {}
    for suffix, put, when in rules:
        by.setdefault(suffix, []).append((put, when))
    return sorted(by.items(), key=lambda x: -len(x[0]))


def _step(rules: list[tuple[str, str, str]]) -> Column:
    w, out = F.col("_w"), None
    for suffix, ways in _cases(rules):
        stem = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        value = w
        for put, when in reversed(ways):
            value = F.when((stem != "") & stem.rlike(when), F.concat(stem, F.lit(put))).otherwise(value)
        out = F.when(w.endswith(suffix), value) if out is None else out.when(w.endswith(suffix), value)
    return out.otherwise(w)


def _tidy() -> Column:
    """After ed or ing went, marked by *: an e is added, or a doubled consonant made single."""
    w = F.rtrim(F.col("_w"), F.lit("*"))
    fixed = F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(DOUBLED), F.substring(w, F.lit(1), F.length(w) - 1)).when(w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w)
    return F.when(F.col("_w").endswith("*"), fixed).otherwise(F.col("_w"))


def stems(words: DataFrame, word_col: str = "word", longer_than: int = 3) -> DataFrame:
    """word, stem for a table of lower-case words; words of up to `longer_than` characters are their own stems."""
    rows = words.select(F.col(word_col).alias("word"), F.regexp_replace(F.col(word_col), "^y", "Y").alias("_w"))
    for rules in STEPS:
        rows = rows.select("word", _step(rules).alias("_w"))
        if rules is STEP_1B:
            rows = rows.select("word", _tidy().alias("_w"))
    stem = F.substring("_w", F.lit(1), F.length("_w") - 1)
    rows = rows.select("word", F.when(F.col("_w").endswith("e") & (stem.rlike(MORE) | (stem.rlike(ONE) & ~stem.rlike(SHORT))), stem).otherwise(F.col("_w")).alias("_w"))
    rows = rows.select("word", F.when(F.col("_w").endswith("ll") & stem.rlike(MORE), stem).otherwise(F.col("_w")).alias("_w"))
    known = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    return rows.select("word", F.when(F.length("word") <= longer_than, F.col("word")).otherwise(F.coalesce(F.try_element_at(known, F.col("word")), F.lower("_w"))).alias("stem"))


def stems_sql(words: str, longer_than: int = 3) -> str:
    """The same as common table expressions, the last one named stems (word, stem), over a query that gives word."""

    def step(rules: list[tuple[str, str, str]]) -> str:
        out = "CASE"
        for suffix, ways in _cases(rules):
            stem = f"substring(w, 1, length(w) - {len(suffix)})"
            inner = "CASE" + "".join(f" WHEN {stem} <> '' AND regexp_matches({stem}, '{when}') THEN {stem} || '{put}'" for put, when in ways) + " ELSE w END"
            out += f" WHEN suffix(w, '{suffix}') THEN {inner}"
        return out + " ELSE w END"

    parts = [f"SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM ({words})"]
    for rules in STEPS:
        parts.append(f"SELECT word, {step(rules)} AS w FROM {{}}")
        if rules is STEP_1B:
            cut = "rtrim(w, '*')"
            parts.append(f"SELECT word, CASE WHEN suffix(w, '*') THEN CASE WHEN regexp_matches({cut}, '(at|bl|iz)$') THEN {cut} || 'e' WHEN regexp_matches({cut}, '{DOUBLED}') THEN substring({cut}, 1, length({cut}) - 1) WHEN regexp_matches({cut}, '{SHORT}') THEN {cut} || 'e' ELSE {cut} END ELSE w END AS w FROM {{}}")
    stem = "substring(w, 1, length(w) - 1)"
    parts.append(f"SELECT word, CASE WHEN suffix(w, 'e') AND (regexp_matches({stem}, '{MORE}') OR (regexp_matches({stem}, '{ONE}') AND NOT regexp_matches({stem}, '{SHORT}'))) THEN {stem} ELSE w END AS w FROM {{}}")
    parts.append(f"SELECT word, CASE WHEN suffix(w, 'll') AND regexp_matches({stem}, '{MORE}') THEN {stem} ELSE w END AS w FROM {{}}")
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    parts.append(f"SELECT word, CASE WHEN length(word) <= {longer_than} THEN word ELSE CASE word {known} ELSE lower(w) END END AS stem FROM {{}}")
    names = [*(f"st{i}" for i in range(len(parts) - 1)), "stems"]
    return ", ".join(f"{n} AS MATERIALIZED ({p.format(names[i - 1]) if i else p})" for i, (n, p) in enumerate(zip(names, parts, strict=True)))
