"""Mixing to target weights with soft membership: document rates whose expected domain totals meet targets.

Method: a naive Bayes classifier, fitted on a labelled table, gives each document a probability for each domain
(hashed words and binned shares of kinds of characters; see posteriors for how evidence adds up). With n tokens and rate x a document adds x * n * p[j]
tokens to domain j. Projected gradient descent, one distributed aggregation a round, minimises

    sum over j of (total[j] - target[j]) ** 2 / (natural[j] * N)  +  ridge * sum over documents of n * (x - 1) ** 2 / N

over rates x >= 0; dividing by the natural totals makes the curvature 1 at most, so that the step is known and a few
rounds suffice; the small ridge keeps rates near 1 where targets leave them free. All of it is DataFrame
expressions. The classifier's weights are a written table of one row, arrays as long as there are places, which later
plans read as a scalar subquery; what reaches the driver's code is a few numbers for each domain.

Defined cases: a null text has no words: its rate is 1 and it adds nothing; rows that share a doc_id each get a rate
(row, a hash of the text, tells them apart); a text of any length is read whole;
labels that are null or whose doc_id is null or absent are left out; a domain without labelled rows has a small
probability everywhere; without any tokens, or an empty table, rates stay 1; of the documents' columns only doc_id
and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import forget, written

PLACES = 1 << 16
TEMPER = 25
#: Log odds against the first domain from which a word is strong, and how many strong words are told apart.
STRONG, MOST = 1.5, 3
#: Character kinds whose shares are binned: (pattern of one character, bounds in thousandths of the text's length).
KINDS = (("[#*$%&|<>]", (2, 20, 100)), ("[A-Z]", (5, 60, 200)), ("!", (2, 20)), ("[.]", (1, 8, 40)))


def evidence(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row of docs (text and columns to keep): n_tokens, and found, the distinct places of its words and bins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(*keep, text.alias("text"))
    # Each kind is counted once, in a step of its own: bins look at a count several times.
    two = one.select(*keep, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)).alias("words"), F.char_length("text").cast("long").alias("size"), *(F.regexp_count("text", F.lit(kind)).cast("long").alias(f"n_{i}") for i, (kind, _) in enumerate(KINDS)))
    bins, at = [], PLACES
    for i, (_, bounds) in enumerate(KINDS):
        place = F.lit(at)
        for b in bounds:
            place = place + F.when(1000 * F.col(f"n_{i}") > b * F.col("size"), 1).otherwise(0)
        bins.append(place.cast("int"))
        at += len(bounds) + 1
    places = F.array_distinct(F.transform("words", lambda w: F.pmod(F.hash(w), F.lit(PLACES))))
    return two.select(*keep, F.size("words").cast("long").alias("n_tokens"), F.concat(places, F.array(*bins)).alias("found"))


WIDTH = PLACES + sum(len(b) + 1 for _, b in KINDS)


class DomainModel:
    """Log priors, a table of one row with the log odds of places and bins, and log weights of numbers of strong words.

    odds: a written table with one array, by_place, of structs w1, w2, ...: domain j's log odds against the first.
    strong[j][d][number] is for domain j + 1's strong words.
    """

    def __init__(self, prior: list[float], odds: DataFrame, strong: list[list[list[float]]]):
        self.prior, self.odds, self.strong = prior, odds, strong

    def weighed(self, rows: DataFrame) -> DataFrame:
        """rows (found) with _w: the log odds w1, w2, ... of each place found.

        The table is looked up once a place, in the step that reads it: as a column of its own it would be copied to each row.
        """
        return rows.select("*", self.odds.scalar().alias("_table")).withColumn("_w", F.transform("found", lambda place: F.get(F.col("_table"), place))).drop("_table")

    def strong_words(self, j: int) -> Column:
        """How many strong words of domain j a text has, MOST at most."""
        return F.least(F.size(F.filter(F.slice(_of_places(j), F.lit(1), F.size("_w") - len(KINDS)), lambda x: x >= STRONG)), F.lit(MOST))


def _of_places(j: int) -> Column:
    """Log odds of the places found, those of words first, for domain j against the first, over weighed() rows."""
    return F.col("_w")[f"w{j}"]


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 6000) -> DomainModel:
    """The model of at most ``sample`` labelled rows (doc_id, domain).

    A word's place counts among all places found in its domain, a bin among the domain's documents: its weight is how its
    number there compares with that expected if all domains were alike, both raised by 4 and a 200th of the rows, so that
    what few rows show by chance weighs little. A second pass counts each domain's texts by how many strong words of each
    other domain they have. Equal hashes at the cut of the sample go by doc_id, then domain.
    """
    marked = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    chosen = F.broadcast(marked.orderBy(F.xxhash64("doc_id", "domain"), "doc_id", "domain").limit(sample))  # bounded
    seen = written(evidence(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id"), "domain"))
    total = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(total.values())
    prior = [math.log((total.get(d, 0) + 1) / (n + len(domains))) for d in domains]
    found = seen.select("domain", F.explode("found").alias("place")).groupBy("place").agg(*(F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)))
    model = DomainModel(prior, written(_log_odds(found, [total.get(d, 0) for d in domains])), [])
    for j in range(1, len(domains)):
        of = {(r["domain"], r["m"]): r["n"] for r in model.weighed(seen).groupBy("domain", model.strong_words(j).alias("m")).agg(F.count("*").alias("n")).collect()}
        model.strong.append([[math.log((of.get((d, m), 0) + 1) / (total.get(d, 0) + MOST + 1)) for m in range(MOST + 1)] for d in domains])
    forget(seen)
    return model


def _log_odds(found: DataFrame, total: list[int]) -> DataFrame:
    """One row with by_place, an array of structs w1, w2, ...: each domain's log odds against the first. found: place, n0, n1, ... (texts of each domain); total: each domain's texts."""
    domains = range(len(total))
    in_words = found.filter(F.col("place") < PLACES).agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in domains)).first()
    in_all, n = max(sum(in_words), 1), sum(total)
    raised = 4 + n / 200
    every = found.sparkSession.range(WIDTH).select(F.col("id").cast("int").alias("place"))
    rows = every.join(found, "place", "left").select("place", *(F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}") for i in domains))
    together = sum((F.col(f"n{i}") for i in domains), F.lit(0))
    shares = [F.when(F.col("place") < PLACES, in_words[i] / in_all).otherwise(total[i] / max(n, 1)) for i in domains]
    weight = [F.log((F.col(f"n{i}") + raised) / (together * shares[i] + raised)) for i in domains]
    by_place = rows.select("place", *((weight[i] - weight[0]).alias(f"w{i}") for i in domains[1:]))
    ordered = by_place.agg(F.array_sort(F.collect_list(F.struct(*by_place.columns))).alias("by_place"))
    return ordered.select(F.transform("by_place", lambda x: F.struct(*(x[f"w{i}"].alias(f"w{i}") for i in domains[1:]))).alias("by_place"))


def posteriors(model: DomainModel) -> list[Column]:
    """The domains' log odds against the first, over weighed() rows.

    A text's words depend on each other, so that the sum of their evidence grows too fast with its length: it is
    drawn in by TEMPER / (TEMPER + places), which bounds it. Strong words count beside that by their number, however long
    the text around them; that a text has none counts too.
    """
    out = []
    for j in range(1, len(model.prior)):
        n = F.size("_w") - len(KINDS)
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        odds = model.prior[j] - model.prior[0] + total(F.slice(_of_places(j), F.lit(-len(KINDS)), F.lit(len(KINDS)))) + total(F.slice(_of_places(j), F.lit(1), n)) * TEMPER / (TEMPER + n)
        for i, by_domain in enumerate(model.strong, 1):
            odds = odds + F.get(F.array(*(F.lit(a - b) for a, b in zip(by_domain[j], by_domain[0], strict=True))), model.strong_words(i))
        out.append(odds)
    return out


def domain_probabilities(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Per row of docs (doc_id, text): row, n_tokens and p, the probability of each domain in order."""
    rows = evidence(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text"), "doc_id", "row")
    rows = model.weighed(rows).select("doc_id", "row", "n_tokens", F.array(F.lit(0.0), *posteriors(model)).alias("odds"))
    rows = rows.withColumn("likely", F.transform("odds", lambda x: F.exp(x - F.array_max("odds"))))
    total = F.aggregate("likely", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("total", total).select("doc_id", "row", "n_tokens", F.transform("likely", lambda x: x / F.col("total")).alias("p"))


def fit_rates(rows: DataFrame, targets: list[float], ridge: float = 0.01, rounds: int = 40, tolerance: float = 1e-7, fixed: int | None = None) -> DataFrame:
    """rows (n_tokens, p) with a column rate, so that sums of rate * n_tokens * p are near targets * sum of n_tokens.

    fixed: a domain whose total is to stay as it is, all targets being scaled alike for that.

    Rates are kept as an expression of the rounds' residuals and written out every eighth round.
    """
    k = len(targets)
    p = [F.col("p")[j] for j in range(k)]
    state = rows.withColumn("rate", F.lit(1.0))
    first = state.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * p[j]).alias(f"t{j}") for j in range(k))).first()
    n = first["n"]
    if not n:
        return state
    natural = [max(first[f"t{j}"] / n, 1e-9) for j in range(k)]
    totals = [first[f"t{j}"] / n for j in range(k)]
    if fixed is not None:
        targets = [t * totals[fixed] / targets[fixed] for t in targets]
    step, rate, old = 1 / (1 + ridge), F.col("rate"), None
    for turn in range(1, rounds + 1):
        pull = sum((p[j] * ((totals[j] - targets[j]) / natural[j]) for j in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate * (1 - step * ridge) - pull * step + step * ridge)
        if turn % 8 == 0:
            state = written(state.withColumn("rate", rate))
            if old is not None:
                forget(old)
            old, rate = state, F.col("rate")
        row = state.withColumn("rate", rate).agg(*(F.sum(F.col("rate") * F.col("n_tokens") * p[j]).alias(f"t{j}") for j in range(k))).first()
        new = [row[f"t{j}"] / n for j in range(k)]
        moved = max(abs(a - b) for a, b in zip(new, totals, strict=True))
        totals = new
        if moved < tolerance:
            break
    return state.withColumn("rate", F.when(F.col("n_tokens") == 0, 1.0).otherwise(rate))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample: int = 6000, fixed: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): row, n_tokens, p (probability of each target's domain, in order) and rate.

    labelled: (doc_id, domain). targets: each domain's tokens wanted, as a share of all tokens there are. fixed: a domain
    that keeps its tokens; targets are then shares of what results.
    """
    model = fit_domains(docs, labelled, list(targets), sample)
    rows = written(domain_probabilities(docs, model))
    forget(model.odds)
    return fit_rates(rows, list(targets.values()), fixed=None if fixed is None else list(targets).index(fixed))


def drawn(doc_id: Column, row: Column, rate: Column) -> Column:
    """Whether a document of a rate below 1 is drawn: by a hash, so always alike. Each rate's share of documents is, near enough."""
    return F.pmod(F.xxhash64(F.lit("drawn"), doc_id, row), F.lit(1 << 30)) < rate * float(1 << 30)


def token_shares(rows: DataFrame, targets: dict[str, float], kept: Column) -> dict[str, float]:
    """The expected share of each domain in the tokens of kept rows of mix()."""
    sums = rows.filter(kept).agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("n_tokens") * F.col("p")[j]).alias(d) for j, d in enumerate(targets))).first()
    return {d: (sums[d] or 0.0) / max(sums["n"] or 0, 1) for d in targets}


def label_domains(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as (doc_id, domain): toxic, else low, else good."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
