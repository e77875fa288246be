"""Full-text documents as lexemes with places and weights: match and rank with array expressions.

Lexemes are lower-cased words without stop words, as English stems. A document is an array of (lexeme, pos, weight): words are numbered
through all parts, stop words too, each part after the last lexeme of the one before. The rank is the database's default one: of
one lexeme the sum of its weights by the squares of their places in the list, the greatest first; of several, how near
each two occurrences of different lexemes stand, put together like independent chances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import dealt

#: Weights by class; the last place that counts, the places of a lexeme that count, and the rank of words that are never apart; English stop words.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LAST_PLACE, MOST_PLACES, NO_RANK = 16383, 256, 1e-20
WORD = r"[\p{L}\p{N}\p{M}]+"
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Fixed values of the English stemmer: words with stems of their own, words that end at the first step, and endings with what takes their place.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
EARLY = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")

_V, _C = "[aeiouy]", "[^aeiouy]"
#: What stands before the first and the second region of a word; Y is a consonant.
_R1 = rf"(?:gener|commun|arsen|(?!gener|commun|arsen){_C}*{_V}+{_C})"
_R2 = rf"(?:{_R1}{_C}*{_V}+{_C})"
_SHORT = rf"(?:^{_V}{_C}|.*{_C}{_V}[^aeiouywxY])"


def _ends(w: Column, endings: dict[str, str], region: dict[str, str], before: dict[str, str]) -> Column:
    """The longest ending that a word has is replaced if it lies in its region and follows what it must."""
    out = w
    for end in sorted(endings, key=len):
        fits = w.rlike(f"^{region.get(end, region[''])}.*(?<={before[end]}){end}$" if end in before else f"^{region.get(end, region[''])}.*{end}$")
        out = F.when(w.endswith(end), F.when(fits, F.concat(F.left(w, F.length(w) - len(end)), F.lit(endings[end]))).otherwise(w)).otherwise(out)
    return out


def _plural(w: Column) -> Column:
    cut = lambda n: F.left(w, F.length(w) - n)
    ied = F.when(F.length(w) > 4, F.concat(cut(3), F.lit("i"))).otherwise(F.concat(cut(3), F.lit("ie")))
    return F.when(w.endswith("sses"), cut(2)).when(w.rlike("(ied|ies)$"), ied).when(w.rlike("(us|ss)$"), w).when(w.rlike(f"{_V}.+s$"), cut(1)).otherwise(w)


def _participle(w: Column) -> Column:
    """The word with what is left of ed and ing marked by a blank, as it may need an e."""
    eed = F.when(w.rlike(f"^{_R1}.*eed(ly)?$"), F.regexp_replace(w, "eed(ly)?$", "ee")).otherwise(w)
    return F.when(w.rlike("eed(ly)?$"), eed).when(w.rlike(f"{_V}.*(ed|edly|ing|ingly)$"), F.regexp_replace(w, "(edly|ingly|ed|ing)$", " ")).otherwise(w)


def _mended(w: Column) -> Column:
    bare = F.rtrim(w)
    short = bare.rlike(f"{_SHORT}$") & ~bare.rlike(f"^{_R1}.")
    mended = F.when(bare.rlike("(at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.left(bare, F.length(bare) - 1)).when(short, F.concat(bare, F.lit("e"))).otherwise(bare)
    return F.when(w.endswith(" "), mended).otherwise(w)


def _last(w: Column) -> Column:
    bare = F.left(w, F.length(w) - 1)
    e = w.rlike(f"^{_R2}.*e$") | (w.rlike(f"^{_R1}.*e$") & ~bare.rlike(f"{_SHORT}$"))
    return F.when(w.endswith("e") & e, bare).when(w.rlike(f"^{_R2}.*(?<=l)l$"), bare).otherwise(w)


def _stemmed(words: Column) -> Column:
    """An array of (w, pos) with English stems for its lower-case words, by the Snowball rules, step by step, so that no step's text is written out twice."""
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    now = F.transform(words, lambda x: F.struct(F.coalesce(F.try_element_at(irregular, x["w"]), x["w"]).alias("w"), x["pos"].alias("pos"), ((F.length(x["w"]) <= 2) | x["w"].isin(*IRREGULAR)).alias("done")))
    apply = lambda rows, step, ends=lambda w: F.lit(False): F.transform(rows, lambda x: F.struct(F.when(x["done"], x["w"]).otherwise(step(x["w"])).alias("w"), x["pos"].alias("pos"), (x["done"] | ends(x["w"])).alias("done")))
    region = {"": _R1}
    now = apply(now, lambda w: F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "(?<=[aeiouy])y", "Y"))
    now = apply(now, _plural)
    now = apply(now, lambda w: w, lambda w: w.isin(*EARLY))
    for step in (
        _participle,
        _mended,
        lambda w: F.regexp_replace(w, "(?<=.[^aeiouy])[yY]$", "i"),
        lambda w: _ends(w, SECOND, region, {"ogi": "l", "li": "[cdeghkmnrt]"}),
        lambda w: _ends(w, THIRD, region | {"ative": _R2}, {}),
        lambda w: _ends(w, dict.fromkeys(FOURTH, ""), {"": _R2}, {"ion": "[st]"}),
        _last,
        F.lower,
    ):
        now = apply(now, step)
    return now


def _numbered(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("pos")))


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words, in their order."""
    return F.transform(_stemmed(_numbered(words)), lambda x: x["w"])


def _placed(c: Column) -> Column:
    """(w, pos) of a text's stems; stop words have places, but are left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), 0)
    return _stemmed(F.filter(_numbered(words), lambda x: ~x["w"].isin(*STOP)))


def lexemes(c: Column) -> Column:
    """Different lexemes in the order in which they come."""
    return F.array_distinct(F.transform(_placed(c), lambda x: x["w"]))


def document(parts: list[tuple[str, Column]]) -> Column:
    """array<struct<lexeme, pos, weight>> of weighted columns, in the order of places."""
    none = F.array().cast("array<struct<lexeme:string,pos:int,weight:double>>")

    each = F.array(*[_weighted(c, WEIGHTS[k]) for k, c in parts])
    return F.aggregate(each, none, _after)


def _weighted(c: Column, weight: float) -> Column:
    return F.transform(_placed(c), lambda x: F.struct(x["w"].alias("lexeme"), x["pos"].cast("int").alias("pos"), F.lit(weight).alias("weight")))


def _after(sofar: Column, part: Column) -> Column:
    """A document with one more part, whose places follow the last one."""
    last = F.coalesce(F.try_element_at(sofar, F.lit(-1))["pos"], F.lit(0))
    return F.concat(sofar, F.transform(part, lambda x: F.struct(x["lexeme"].alias("lexeme"), F.least(x["pos"] + last, F.lit(LAST_PLACE)).cast("int").alias("pos"), x["weight"].alias("weight"))))


def with_document(df: DataFrame, parts: list[tuple[str, Column]], name: str = "doc") -> DataFrame:
    """Rows with their document, dealt out first: stems cost far more time than a small file's bytes let Spark expect. As the one
    row of a list a document is made once, however often a filter and a rank name it, and filters stay behind it."""
    return dealt(df).select("*", F.explode(F.array(document(parts))).alias(name))


def rank_of(doc: Column, query: Column) -> Column:
    """Rank of a document for the different lexemes of a query, all of which it should hold."""
    hits = F.filter(doc, lambda x: F.array_contains(query, x["lexeme"]))
    first = F.slice(hits, 1, MOST_PLACES)
    weights = F.transform(first, lambda x: x["weight"])
    most = F.array_max(weights)
    summed = F.aggregate(F.transform(weights, lambda w, j: w / ((j + 1) * (j + 1))), F.lit(0.0), lambda s, x: s + x)
    at = F.array_position(weights, most)
    one = (most + summed - most / (at * at)) / 1.64493406685
    near = lambda d: F.when(d > 100, 1e-30).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))
    apart = lambda a, b: F.sqrt(a["weight"] * b["weight"] * near(F.abs(a["pos"] - b["pos"])))
    pairs = lambda a: F.aggregate(hits, F.lit(1.0), lambda s, b: F.when((b["lexeme"] < a["lexeme"]) & (a["pos"] != b["pos"]), s * (1.0 - apart(a, b))).otherwise(s))
    some = F.exists(hits, lambda a: F.exists(hits, lambda b: (b["lexeme"] < a["lexeme"]) & (a["pos"] != b["pos"])))
    all_ = F.when(some, 1.0 - F.aggregate(hits, F.lit(1.0), lambda s, a: s * pairs(a))).otherwise(NO_RANK)
    return F.when(F.size(hits) == 0, 0.0).when(F.size(query) < 2, one).otherwise(all_)


def matches(df: DataFrame, doc: str, query: str) -> DataFrame:
    """Rows that hold every lexeme of the query; a query of stop words only matches nothing."""
    q = lexemes(F.lit(query))
    return df.where((F.size(q) > 0) & (F.size(F.array_except(q, F.transform(doc, lambda x: x["lexeme"]))) == 0))


def ranked(df: DataFrame, doc: str, query: str) -> DataFrame:
    """Matches with rank."""
    return matches(df, doc, query).withColumn("rank", rank_of(F.col(doc), lexemes(F.lit(query))))
