"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import handed_back, numbered, words

#: A category for values that a marginal does not name.
OTHER = "*"
#: Of the tokens of the mixture, by source, language and topic; OTHER gathers what is not named.
TARGETS = {
    "source": {"src0": 0.30, OTHER: 0.70},
    "lang": {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.12},
    "topic": {"note": 0.004, "table": 0.036, "prose": 0.96},
}
#: Instead of a share: a category keeps the one that it has, and the others divide what is left.
HELD = None
#: The targets of a corpus whose languages need not be named: no language is left out, and none
#: that is rare is blown up.
ALL_LANGUAGES = TARGETS | {"lang": TARGETS["lang"] | {OTHER: HELD}}
#: Rounds over all marginals; a round is three scalings of at most a few dozen cells.
ROUNDS = 25


def topic(text: Column) -> Column:
    """A coarse form of a text: table (it has a bar), note (fewer than 60 words) or prose."""
    return (
        F.when(F.instr(text, "|") > 0, "table")
        .when(F.size(words(text)) < 60, "note")
        .otherwise("prose")
    )


def rake(cells: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Scale a table of token weights until each axis has its target shares.

    A category without tokens cannot be reached: its share falls to the others of its
    axis. An empty table stays as it is.
    """
    weights = cells.astype(float)
    if weights.sum() == 0:
        return weights
    for _ in range(rounds):
        for axis, shares in enumerate(targets):
            others = tuple(i for i in range(weights.ndim) if i != axis)
            have = weights.sum(axis=others)
            wanted = np.where(have > 0, shares, 0.0)
            factor = np.divide(
                wanted / wanted.sum(), have, out=np.zeros_like(have), where=have > 0
            )
            weights = weights * factor.reshape([-1 if i == axis else 1 for i in range(weights.ndim)])
    return weights


def chance(doc_id: Column) -> Column:
    """A number in [0, 1) fixed by the id: 52 bits of its MD5; null counts as the text 'null'."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float | None]] = TARGETS,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    rounds: int = ROUNDS,
) -> DataFrame:
    """The rows with n_tokens (words), topic, probability and sampled (drawn into the mixture).

    Cells are combinations of source, language and topic as far as the marginals name
    them; what they do not name, nulls included, falls to OTHER, and to probability 0
    where a marginal has no OTHER. A category whose target is HELD keeps its share of the
    tokens. Cell tokens are raked to the marginals; a document's
    probability is its cell's raked weight over its cell's tokens, scaled so that the
    largest is 1. The draw depends on the id alone, so rows that repeat an id are drawn
    alike. Documents without words weigh nothing and have their cell's probability.

    The table of cells has at most one row for each combination of named categories:
    its size is fixed by the targets, not by the data, so the driver may hold it.
    Input columns of the names of the four added ones are replaced by these.
    """
    rows, places = numbered(docs)
    body = F.col(places[text])
    axes = {"source": F.col(places[source]), "lang": F.col(places[lang]), "topic": topic(body)}
    names = {axis: list(targets[axis]) for axis in axes}
    counted = rows.withColumns({"n_tokens": F.size(words(body)).cast("long"), "topic": axes["topic"]})

    def category(axis: str, value: Column) -> Column:
        found = F.when(value.isin([n for n in names[axis] if n != OTHER]), value)
        return F.coalesce(found, F.lit(OTHER))

    keys = {f"__{axis}": category(axis, value) for axis, value in (axes | {"topic": F.col("topic")}).items()}
    shape = {axis: [*names[axis], *([] if OTHER in names[axis] else [OTHER])] for axis in axes}
    cells = np.zeros([len(v) for v in shape.values()])
    sums = counted.select(*[v.alias(k) for k, v in keys.items()], "n_tokens")
    for row in sums.groupBy(*keys).agg(F.sum("n_tokens").alias("n")).collect():
        place = tuple(shape[axis].index(row[f"__{axis}"]) for axis in axes)
        if all(row[f"__{axis}"] in names[axis] for axis in axes):
            cells[place] = row["n"]
    shares = []
    for at, axis in enumerate(axes):
        held = cells.sum(axis=tuple(i for i in range(cells.ndim) if i != at)) / max(1.0, cells.sum())
        fixed = np.array([targets[axis].get(v, 0.0) is HELD for v in shape[axis]])
        given = np.array([targets[axis].get(v) or 0.0 for v in shape[axis]])
        # What is named and has tokens divides what is left.
        reached = given[held > 0].sum()
        left = (1 - held[fixed].sum()) / reached if fixed.any() and held[fixed].sum() and reached else 1.0
        shares.append(np.where(fixed, held, given * left))
    raked = rake(cells, shares, rounds)
    rates = np.divide(raked, cells, out=np.zeros_like(cells), where=cells > 0)
    if rates.max(initial=0) > 0:
        rates = rates / rates.max()
    probability = F.lit(0.0)
    for place in zip(*np.nonzero(rates)):
        here = [F.col(f"__{axis}") == shape[axis][i] for axis, i in zip(axes, place)]
        probability = F.when(here[0] & here[1] & here[2], float(rates[place])).otherwise(probability)
    out = counted.withColumns(keys).withColumn("probability", probability)
    out = out.withColumn("sampled", chance(F.col(places[doc_id])) < F.col("probability"))
    return handed_back(out, places, ("n_tokens", "topic", "probability", "sampled"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs, ALL_LANGUAGES).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 9).alias("probability"), "sampled"
    )


def _sql() -> str:
    """The raking as nested window sums, one for each scaling."""
    targets = ALL_LANGUAGES
    listed = lambda axis: ", ".join(f"('{n}', {'NULL' if w is HELD else repr(w)})" for n, w in targets[axis].items())
    named = lambda axis: ", ".join(f"'{n}'" for n in targets[axis] if n != OTHER)
    other = {axis: f"'{OTHER}'" for axis in TARGETS}
    steps, last = [], "c0"
    for k in range(ROUNDS * len(TARGETS)):
        axis = list(TARGETS)[k % len(TARGETS)]
        steps.append(
            f"c{k + 1} AS MATERIALIZED (SELECT * EXCLUDE w, w * t_{axis} / sum(w) OVER (PARTITION BY c_{axis}) AS w FROM {last})"
        )
        last = f"c{k + 1}"
    category = lambda axis: f"CASE WHEN {axis} IN ({named(axis)}) THEN {axis} ELSE {other[axis]} END AS c_{axis}"
    shares = ", ".join(
        f"h_{axis} AS (SELECT c_{axis} AS v, sum(n) / sum(sum(n)) OVER () AS held FROM cells GROUP BY c_{axis}), "
        f"s_{axis} AS (SELECT v AS c_{axis}, coalesce(t / sum(t) OVER () * (1 - coalesce(sum(held) FILTER (t IS NULL) OVER (), 0)), held) AS t_{axis}"
        f" FROM (VALUES {listed(axis)}) x(v, t) JOIN h_{axis} USING (v) WHERE held > 0)"
        for axis in TARGETS
    )
    return f"""
WITH counted AS (
  SELECT doc_id, source, lang,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         contains(coalesce(text, ''), '|') AS bar
  FROM documents
),
docs AS (
  SELECT *, CASE WHEN bar THEN 'table' WHEN n_tokens < 60 THEN 'note' ELSE 'prose' END AS topic FROM counted
),
placed AS (SELECT *, {", ".join(map(category, TARGETS))} FROM docs),
cells AS (SELECT c_source, c_lang, c_topic, sum(n_tokens) AS n FROM placed GROUP BY ALL),
{shares},
c0 AS (
  SELECT *, CAST(n AS DOUBLE) AS w FROM cells
  JOIN s_source USING (c_source) JOIN s_lang USING (c_lang) JOIN s_topic USING (c_topic) WHERE n > 0
),
{", ".join(steps)},
rates AS (SELECT c_source, c_lang, c_topic, (w / n) / max(w / n) OVER () AS p FROM {last})
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens,
       round(coalesce(p, 0.0), 9) AS probability,
       CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0
         < coalesce(p, 0.0) AS sampled
FROM placed LEFT JOIN rates USING (c_source, c_lang, c_topic)
"""


SQL = _sql()
