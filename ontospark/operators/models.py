"""The model surface: encoders and generators as functions loaded once per worker (X1-X5, X17), and what their scores become (X7, X13, X20,
F3, F4, O1, A25, J19).

A model is given as a factory without arguments that returns a callable on a list of texts; it is called in each Python worker, once. What a
model is, is outside; ``LetterEncoder`` and ``WordGenerator`` are small deterministic stand-ins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontospark.functions import prompts
from ontospark.operators import metrics, similarity

Encoder = Callable[[list[str]], np.ndarray]
Generator = Callable[[list[str]], list[str]]


class LetterEncoder:
    """Counts of the letters a to z in lower case."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(chr(c)) for c in range(97, 123)] for t in texts], float).reshape(len(texts), 26)


class WordGenerator:
    """Answers with the words of more than three letters of the prompt's last line, in JSON inside other words; a prompt whose length
    is divisible by ``fails`` gets an answer without JSON."""

    def __init__(self, fails: int = 0):
        self.fails = fails

    def __call__(self, prompts: list[str]) -> list[str]:
        said = []
        for p in prompts:
            types = [w for w in p.rsplit("\n", 1)[-1].split(" ") if len(w) > 3]
            said.append("no answer" if self.fails and len(p) % self.fails == 0 else "So: " + json.dumps({"types": types}) + " as asked")
        return said


def encode(text: Column, load: Callable[[], Encoder], batch: int = 32, most: int | None = None, unit: bool = True) -> Column:
    """A vector for each text, in model batches of ``batch``; null stays null (X1). ``most``: characters read of a text (P21). ``unit``:
    scaled to length 1, a zero vector stays as it is. Each distinct text of an Arrow batch is encoded once."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            code, once = pd.factorize(texts if most is None else texts.str.slice(0, most))
            out: list = []
            for at in range(0, len(once), batch):
                v = np.asarray(model(list(once[at : at + batch])), float)
                if unit:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                out.extend(v)
            yield pd.Series([out[c] if c >= 0 else None for c in code], index=texts.index, dtype=object)

    return run(text)


ANSWER = "struct<types:array<string>,text:string,attempts:int,ok:boolean>"


def generate(prompt: Column, load: Callable[[], Generator], parse: Callable[[str], list[str]] | None = None, fallback: Callable[[], Generator] | None = None, retries: int = 3, batch: int = 8) -> Column:
    """``(types, text, attempts, ok)`` for each prompt.

    A batch is asked at once; prompts whose answer ``parse`` refuses (an exception) are asked again, up to ``retries`` times, then once
    of ``fallback`` (None: the same model), whose answer counts whatever it holds, as an empty list where nothing can be read from it. A
    model that raises counts as an answer refused. A null prompt gets no types and no attempt."""
    read = parse or strict_types

    @F.pandas_udf(ANSWER)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        spare = fallback() if fallback else model
        for prompts_ in parts:
            asked = prompts_.tolist()
            rows: list[dict] = [{"types": [], "text": None, "attempts": 0, "ok": False} for _ in asked]
            open_ = [i for i, p in enumerate(asked) if p is not None]
            for attempt in range(1, retries + 1):
                left = []
                for at in range(0, len(open_), batch):
                    some = open_[at : at + batch]
                    for i, said in zip(some, _said(model, [asked[i] for i in some])):
                        try:
                            rows[i] = {"types": sorted(set(read(said))), "text": said, "attempts": attempt, "ok": True}
                        except Exception:
                            rows[i]["attempts"] = attempt
                            left.append(i)
                open_ = left
            for at in range(0, len(open_), batch):
                some = open_[at : at + batch]
                for i, said in zip(some, _said(spare, [asked[i] for i in some])):
                    rows[i] |= {"types": sorted(set(loose_types(said))), "text": said}
            yield pd.DataFrame(rows, columns=["types", "text", "attempts", "ok"], index=prompts_.index)

    return run(prompt)


def _said(model: Generator, asked: list[str]) -> list[str | None]:
    """Answers of a batch; where the batch fails, each prompt by itself, and null for one that fails alone."""
    try:
        return list(model(asked))
    except Exception:
        if len(asked) == 1:
            return [None]
        return [_said(model, [p])[0] for p in asked]


def strict_types(said: str) -> list[str]:
    """The types of an answer that is JSON from its first brace to its last; anything else is refused."""
    found = json.loads(said[said.index("{") : said.rindex("}") + 1])["types"]
    if not all(isinstance(t, str) for t in found):
        raise ValueError("types must be texts")
    return found


def loose_types(said: str | None) -> list[str]:
    """The types that can be read from an answer, else none."""
    try:
        return strict_types(said or "")
    except Exception:
        return []


def predict_types(terms: DataFrame, load: Callable[[], Generator], shots: Column | None = None, most: int | None = None, **options) -> DataFrame:
    """``(id, term, types, text, attempts, ok)`` of rows with an id and a term, by few-shot prompts (X4; a table of one row is X5). A row
    without an id fails the query, as a result without one can't be told apart."""
    none = F.lit(None).cast("array<struct<term:string,types:array<string>>>")
    prompt = prompts.chat_template(prompts.conversation(prompts.few_shot(none if shots is None else shots, F.col("term"), most)), ask=True)
    key = F.when(F.col("id").isNotNull(), F.col("id")).otherwise(F.raise_error(F.lit("a term without an id")))
    return terms.select(key.alias("id"), "term", generate(prompt, load, **options).alias("a")).select("id", "term", "a.*")


def typing_metrics(terms: DataFrame, predicted: DataFrame) -> DataFrame:
    """Example metrics (A10) of predictions against ``terms (id, types)``; no row where no term has types."""
    truth = terms.filter(F.size(F.coalesce("types", F.array())) > 0).select("id", F.col("types").alias("truth"))
    return metrics.set_metrics(predicted.select("id", F.col("types").alias("guess")).join(truth, "id"), "truth", "guess").filter("n > 0")


def extract_relationships(scores: DataFrame, threshold: float, min_confidence: float | None = None, most: int | None = None, loops: str | None = "position", names: DataFrame | None = None) -> DataFrame:
    """``(child_id, parent_id, confidence[, child, parent])`` from ``(i, j, score)``: i is child of j where the score is strictly over the
    threshold and, if asked, not under ``min_confidence``; the ``most`` surest, ties by smaller ids (X20, F2-F4, O1).

    ``loops``: pairs to leave out, of one ``position`` or of one ``text`` (needs ``names (id, text)``), or None."""
    kept = scores.filter(F.col("score") > threshold)
    if min_confidence is not None:
        kept = kept.filter(F.col("score") >= min_confidence)
    if loops == "position":
        kept = kept.filter("i <> j")
    kept = kept.select(F.col("i").alias("child_id"), F.col("j").alias("parent_id"), F.col("score").alias("confidence"))
    if names is not None:
        kept = kept.join(names.select(F.col("id").alias("child_id"), F.col("text").alias("child")), "child_id").join(names.select(F.col("id").alias("parent_id"), F.col("text").alias("parent")), "parent_id")
        if loops == "text":
            kept = kept.filter("child <> parent")
    return kept if most is None else kept.orderBy(F.col("confidence").desc(), "child_id", "parent_id").limit(most)


def confidence_stats(found: DataFrame) -> DataFrame:
    """``(n, parents, children, low, high, mean, std)`` of extracted relations."""
    c = F.col("confidence")
    return found.agg(F.count("*").alias("n"), F.count_distinct("parent_id").alias("parents"), F.count_distinct("child_id").alias("children"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))


def relation_ratios(found: int, terms: int, known: int, known_terms: int) -> dict[str, float]:
    """Relations per term and, in percent, per pair of terms, of a result and of what it was trained on (A24); no terms give 0."""
    share = lambda a, b: a / b if b else 0.0
    return {
        "square_ratio": 100 * share(found, terms**2), "expected_square_ratio": 100 * share(known, known_terms**2),
        "ratio": share(found, terms), "expected_ratio": share(known, known_terms),
    }


def threshold_rerun(scores: DataFrame, old: float, new: float) -> DataFrame:
    """``(old_threshold, new_threshold, total, old_pairs, new_pairs, difference, low, high, mean, std)`` over a stored score table: what
    another threshold gives without scoring again (X13, J19, K12). One pass; i = j never counts as a pair."""
    s, off = F.col("score"), F.col("i") != F.col("j")
    rows = scores.agg(
        F.count_if(off).alias("total"), F.count_if(off & (s > old)).alias("old_pairs"), F.count_if(off & (s > new)).alias("new_pairs"),
        F.min(s).alias("low"), F.max(s).alias("high"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"),
    )
    return rows.select(F.lit(float(old)).alias("old_threshold"), F.lit(float(new)).alias("new_threshold"), "total", "old_pairs", "new_pairs", (F.col("new_pairs") - F.col("old_pairs")).alias("difference"), "low", "high", "mean", "std")


def changed_pairs(scores: DataFrame, old: float, new: float) -> DataFrame:
    """``(i, j, score, change)``: pairs that one of two thresholds gives and the other doesn't, as ``gained`` or ``lost``."""
    s = F.col("score")
    return scores.filter((F.col("i") != F.col("j")) & ((s > old) != (s > new))).select("i", "j", "score", F.when(s > new, "gained").otherwise("lost").alias("change"))


def predict_hierarchy(terms: DataFrame, load: Callable[[], Encoder], threshold: float | None = None, stored: float | None = None, heads: int = 2, key_block: int | None = None, loops: str | None = "position", **options) -> DataFrame:
    """``(child_id, parent_id, confidence, child, parent)``: ``terms (id, text)`` encoded once, scored all against all by the query/key
    head, and cut at the threshold: the one given, else the stored one, else 0.5 (X7). Null texts are left out."""
    cut = threshold if threshold is not None else stored if stored is not None else 0.5
    vectors = terms.filter("text is not null").select("id", encode(F.col("text"), load, **options).alias("v"))
    scores = similarity.attention(vectors, "id", "v", heads, key_block, above=cut)
    return extract_relationships(scores, cut, loops=loops, names=terms)
