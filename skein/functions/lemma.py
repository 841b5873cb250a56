"""Lemmas: detachment rules with a table of exceptions, checked against a vocabulary.

A word's candidates are what the rules leave of it, in order of the rules; the lemma is the exception, or the first candidate
that the vocabulary holds, or the word itself. The vocabulary is the corpus's own (or any table of words), and the check is
a join: candidates are at most as many as the rules, words are looked up once each, however often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings and what replaces them, by part of speech: nouns, verbs, adjectives.
NOUN = [("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", "")]
VERB = [("ies", "y"), ("es", "e"), ("es", ""), ("s", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")]
ADJECTIVE = [("er", "e"), ("er", ""), ("est", "e"), ("est", "")]
#: Irregular forms and their lemmas.
IRREGULAR = {
    "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be",
    "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do", "doing": "do",
    "went": "go", "gone": "go", "goes": "go", "said": "say", "made": "make", "took": "take", "taken": "take",
    "came": "come", "saw": "see", "seen": "see", "knew": "know", "known": "know", "got": "get", "gotten": "get",
    "gave": "give", "given": "give", "found": "find", "thought": "think", "told": "tell", "became": "become",
    "left": "leave", "felt": "feel", "brought": "bring", "began": "begin", "begun": "begin", "kept": "keep",
    "held": "hold", "wrote": "write", "written": "write", "stood": "stand", "heard": "hear", "meant": "mean",
    "met": "meet", "ran": "run", "running": "run", "paid": "pay", "sat": "sit", "spoke": "speak", "spoken": "speak",
    "led": "lead", "grew": "grow", "grown": "grow", "lost": "lose", "fell": "fall", "fallen": "fall", "sent": "send",
    "built": "build", "understood": "understand", "drew": "draw", "drawn": "draw", "broke": "break", "broken": "break",
    "spent": "spend", "rose": "rise", "risen": "rise", "drove": "drive", "driven": "drive", "bought": "buy", "wore": "wear",
    "chose": "choose", "chosen": "choose", "ate": "eat", "eaten": "eat", "flew": "fly", "flown": "fly", "won": "win",
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth",
    "mice": "mouse", "geese": "goose", "lives": "life", "wives": "wife", "leaves": "leaf", "data": "datum",
    "criteria": "criterion", "phenomena": "phenomenon", "analyses": "analysis", "theses": "thesis", "indices": "index",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "further": "far", "less": "little",
}
SHORTEST = 2


def rules() -> list[tuple[str, str]]:
    """Ending and replacement, each pair once, in the order in which they are tried."""
    return list(dict.fromkeys([*NOUN, *VERB, *ADJECTIVE]))


def candidates(word: str) -> Column:
    """Number of the rule and what it leaves of a word (a column's name), for the rules that apply."""
    # in SQL text: each rule is a struct or null
    parts = ", ".join(f"if(endswith({word}, '{e}') and length({word}) - {len(e)} + {len(n)} >= {SHORTEST}, struct({i} as rule, concat(substring({word}, 1, length({word}) - {len(e)}), '{n}') as lemma), null)" for i, (e, n) in enumerate(rules()))
    return F.expr(f"filter(array({parts}), x -> x is not null)")


def lemma_table(words: DataFrame, vocabulary: DataFrame | None = None, column: str = "term") -> DataFrame:
    """term and lemma of the words (term) whose lemma is another word. Candidates are looked up in the vocabulary (term),
    which is the words themselves by default."""
    distinct = words.filter(F.col(column).isNotNull()).select(F.col(column).alias("w")).distinct()
    known = (distinct if vocabulary is None else vocabulary.select(F.col(column).alias("w")).distinct()).withColumnRenamed("w", "lemma")
    odd = words.sparkSession.createDataFrame(list(IRREGULAR.items()), "w string, lemma string")
    irregular = distinct.join(F.broadcast(odd), "w")  # the fixed table
    found = distinct.join(F.broadcast(odd), "w", "left_anti").select("w", F.explode(candidates("w")).alias("c")).select("w", "c.rule", "c.lemma")
    regular = found.join(known, "lemma").groupBy("w").agg(F.min(F.struct("rule", "lemma")).alias("m")).select("w", "m.lemma")
    return regular.unionByName(irregular).filter("w <> lemma").select(F.col("w").alias(column), "lemma")


def lemmatized_counts(counts: DataFrame, table: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Counts of terms (by, term, n) as counts of their lemmas."""
    both = counts.join(table, "term", "left").withColumn("term", F.coalesce("lemma", "term"))
    return both.groupBy(*by, "term").agg(F.sum(n).alias(n))


def lemmatized(docs: DataFrame, table: DataFrame, tokens: str = "tokens", id_col: str = "doc_idx") -> DataFrame:
    """id and tokens of each document (token arrays) with lemmas in place of words. Each different word of a document is
    looked up once."""
    words = docs.select(id_col, F.explode(F.array_distinct(tokens)).alias("term")).join(table, "term")
    maps = words.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("term", "lemma"))).alias("__m"))  # words of a document
    out = docs.join(maps, id_col, "left")
    return out.select(id_col, F.when(F.col("__m").isNull(), F.col(tokens)).otherwise(F.transform(tokens, lambda w: F.coalesce(F.col("__m")[w], w))).alias(tokens))


def rules_sql(words: str) -> str:
    """The same table in SQL: a query for w and lemma of the words (a relation with the column w)."""
    odd = ", ".join(f"('{k}', '{v}')" for k, v in IRREGULAR.items())
    each = " UNION ALL ".join(f"SELECT w, {i} AS rule, substring(w, 1, length(w) - {len(e)}) || '{n}' AS lemma FROM {words} WHERE suffix(w, '{e}') AND length(w) - {len(e)} + {len(n)} >= {SHORTEST}" for i, (e, n) in enumerate(rules()))
    return f"""SELECT w, lemma FROM (SELECT w, arg_min(lemma, rule) AS lemma FROM ({each}) WHERE lemma IN (SELECT w FROM {words}) AND w NOT IN (SELECT k FROM (VALUES {odd}) o(k, v)) GROUP BY w
      UNION ALL SELECT w, v FROM {words} JOIN (VALUES {odd}) o(k, v) ON w = k) WHERE w <> lemma"""
