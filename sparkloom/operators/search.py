"""Search over the store's texts: an inverted index with stemmed words, ranked by BM25, and the tools on top of it."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import contains

#: Of the ranking formula.
K1, B = 1.2, 0.75


def _form(w: str) -> str:
    """c for consonants, v for vowels; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _form(w)))


# Fixed values of the Porter algorithm: endings and what takes their place, tried longest first within a step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """Porter's stem of a lower-case word."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    cvc = lambda s: len(s) > 2 and _form(s)[-3:] == "cvc" and s[-1] not in "wxy"
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif end := next((e for e in ("ed", "ing") if w.endswith(e) and "v" in _form(w[: -len(e)])), None):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _form(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _form(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        if end := max((e for e in table if w.endswith(e)), key=len, default=None):
            w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) else w
    if end := max((e for e in STEP4 if w.endswith(e)), key=len, default=None):
        rest = w[: -len(end)]
        if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws] if ws is not None else [])


def stems(words: Column) -> Column:
    return F.pandas_udf(_stems, "array<string>")(words)


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, accents taken off Latin letters."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index(docs: DataFrame, key: str, text: Column, stemmed: bool = True) -> DataFrame:
    """Postings (key, word, tf, size): how often each word stands in each text, and the text's number of words."""
    w = words(text)
    rows = docs.select(F.col(key).alias("key"), w.alias("ws")).withColumn("size", F.size("ws"))
    rows = rows.select("key", "size", F.explode(stems(F.col("ws")) if stemmed else F.col("ws")).alias("word"))
    return rows.groupBy("key", "size", "word").agg(F.count("*").alias("tf")).select("key", "word", "tf", "size")


def parsed_match(match: str, stemmed: bool = True) -> list[list[str]]:
    """A MATCH text as alternatives (OR) of words that must all stand; quoted phrases count as their words, NOT is no word."""
    out: list[list[str]] = [[]]
    for part in re.findall(r'"[^"]*"|\S+', match):
        if part == "OR":
            out.append([])
        elif part != "AND":
            out[-1] += [stem(w) if stemmed else w for w in re.findall(r"\w+", part.lower())]
    return [x for x in out if x]


def bm25(postings: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """key, rank for the texts that hold all words of an alternative; the better, the higher. Words of the query alone leave the index."""
    spark = postings.sparkSession
    sizes = postings.groupBy("key").agg(F.max("size").alias("size")).agg(F.count("*").alias("n_docs"), F.avg("size").alias("mean"))
    groups = spark.createDataFrame([(g, w) for g, ws in enumerate(wanted) for w in set(ws)], "grp int, word string")
    need = groups.groupBy("grp").agg(F.count("*").alias("need"))
    hits = postings.join(F.broadcast(groups), "word")  # as many rows as the query has words
    held = hits.groupBy("key", "grp").agg(F.count("*").alias("got")).join(F.broadcast(need), "grp").where("got = need").select("key").distinct()
    terms = postings.join(F.broadcast(groups.select("word").distinct()), "word")
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    scored = terms.join(held, "key", "left_semi").join(F.broadcast(df), "word").crossJoin(F.broadcast(sizes))  # one row
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return scored.groupBy("key").agg(F.round(F.sum(idf * tf), 6).alias("rank"))


def snippet(text: Column, word: str, width: int = 40) -> Column:
    """The text around the first place of a word, marked."""
    at = F.locate(word.lower(), F.lower(text))
    part = F.substring(text, F.greatest(at - width, F.lit(1)), F.lit(2 * width + len(word)))
    return F.when(at > 0, F.regexp_replace(part, f"(?i)({re.escape(word)})", "[$1]")).otherwise(F.substring(text, 1, 2 * width))


def hybrid(full_text: DataFrame, assets: DataFrame, text: str) -> DataFrame:
    """id, how, place: hits of the index (key, rank) by rank first, then assets that merely hold the text; each once."""
    a = full_text.select(F.col("key").alias("id"), F.lit("text").alias("how"), F.lit(0).alias("tier"), (-F.col("rank")).alias("rank"))
    b = assets.where(contains(text, "id", "name", "description")).select("id", F.lit("like").alias("how"), F.lit(1).alias("tier"), F.lit(0.0).alias("rank"))
    one = a.unionByName(b).groupBy("id").agg(F.min_by(F.struct("how", "tier", "rank"), F.struct("tier", "rank")).alias("x")).select("id", "x.*")
    return one.select("id", "how", F.row_number().over(Window.orderBy("tier", "rank", "id")).alias("place"))


def suggested(assets: DataFrame, columns: DataFrame, text: str, most: int = 10) -> DataFrame:
    """id, score of assets that hold the text: half for the name, half for the Jaccard likeness of the text's words and the columns' names (asset, columns array). A report of `most`."""
    asked = F.array(*(F.lit(w) for w in dict.fromkeys(text.lower().split()))) if text.split() else F.array().cast("array<string>")
    rows = assets.where(contains(text, "id", "name", "description")).join(columns, assets["id"] == columns["asset"], "left")
    names = F.array_distinct(F.transform(F.coalesce("columns", F.array().cast("array<string>")), F.lower))
    both = F.size(F.array_intersect(asked, names)) / F.greatest(F.size(F.array_union(asked, names)), F.lit(1))
    like = F.when(F.size(names) > 0, both).otherwise(0.0)
    score = F.round(0.5 * F.contains(F.lower("name"), F.lit(text.lower())).cast("int") + 0.5 * like, 6)
    return rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(most)


def found_terms(terms: DataFrame, notes: DataFrame, assets: DataFrame, text: str) -> DataFrame:
    """what, id of glossary terms (name, definition), annotations (key, rank of the index) and assets that speak of the text."""
    a = terms.where(contains(text, "name", "definition")).select(F.lit("term").alias("what"), F.col("name").alias("id"))
    b = notes.select(F.lit("annotation").alias("what"), F.col("key").alias("id"))
    return a.unionByName(b).unionByName(assets.where(contains(text, "id", "name", "description")).select(F.lit("asset").alias("what"), "id"))


def explained(columns: DataFrame, notes: DataFrame, profiles: DataFrame) -> DataFrame:
    """Columns (asset, column_name, type) with their notes (asset, column_name, note) and profiles (asset, column_name, n_distinct, null_fraction), where known."""
    keys = ["asset", "column_name"]
    return columns.join(notes, keys, "left").join(profiles, keys, "left")
