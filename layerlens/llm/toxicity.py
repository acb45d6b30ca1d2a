"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.  Features are DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerlens.llm.common import Scratch, let, text_of

#: Abuse by language, pronouns of the second person, and letters that digits and signs stand for.
ABUSE = (
    "idiot idiots stupid moron moronic loser losers pathetic worthless scum trash disgusting clown dumb imbecile fool jerk vermin garbage hate retard "
    "freak filthy filth pig dumbass asshole bastard bitch shit fuck fucking kill die "
    "idiota estúpido imbécil basura asqueroso patético inútil mierda puta tonto escoria "
    "idiote stupide imbécile crétin minable ordure dégoûtant connard merde salope débile racaille "
    "dumm blödmann trottel abschaum widerlich erbärmlich wertlos arschloch scheiße schwachkopf dreck depp"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú usted ustedes vosotros".split()
DISGUISE = ("@4310$5!7", "aaeiossit")
NEAR = 6
#: Bounds of the fit: labelled rows used, learned words and stems kept, documents a learned word must stand in.
TRAIN_ROWS, LEARNED, SUPPORT = 20_000, 2000, 5
#: Settings of the learned lexicon, log odds and their z score, of which the fit chooses one on training rows.
SETTINGS = ((1.5, 4.0), (1.0, 3.0), (2.0, 4.0), (1.5, 6.0))
#: Share of the uncalibrated score in the result: it parts texts that the calibration's steps leave level.
UNLEVEL = 0.02
#: Lengths of the word beginnings that are learned besides words, for languages that inflect or compound.
STEMS = (4, 5, 7)

_WORD = r"[\p{L}\p{N}@$!*]*[\p{L}\p{N}]"


def _words(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def _literal(tokens: list[str]) -> Column:
    return F.array(*map(F.lit, tokens)) if tokens else F.array().cast("array<string>")


def _at_least(k: int):
    return lambda x: F.length(x) >= k


def _beginning(k: int):
    return lambda x: F.substring(x, 1, k)


def _stems(words: Column) -> Column:
    return F.array_distinct(F.flatten(F.array(*(F.transform(F.filter(words, _at_least(k)), _beginning(k)) for k in STEMS))))


def _among(words: Column, stems: list[str]) -> Column:
    """The words that begin with a learned stem; each length is one look-up in a hash set."""
    sets = {k: [x for x in stems if len(x) == k] for k in STEMS}
    test = lambda x: reduce(or_, (F.substring(x, 1, k).isin(v) for k, v in sets.items() if v))
    return F.filter(words, test) if any(sets.values()) else F.array().cast("array<string>")


def _chars(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


FEATURES = (
    "abuse_density", "abuse_kinds", "learned_density", "learned_kinds", "stem_density", "stem_kinds", "second_person_density", "nearest_you", "capitals", "shouted", "marks", "mark_runs", "obfuscated", "drawn_out", "log_words",
)


def features(text: Column, learned: list[str], stems: list[str]) -> Column:
    """struct of doubles, FEATURES in order: lexicon densities and kinds, distance of abuse to a second person, capitals,
    punctuation and obfuscation rates.  Every count runs over the whole text."""
    abuse, you = _literal(sorted(set(ABUSE))), _literal(SECOND_PERSON)

    def measured(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(w)).cast("double")

        def with_sets(d: Column) -> Column:
            veiled = F.transform(F.filter(d["words"], lambda x: x.rlike(r"[0-9@$!]")), lambda x: F.translate(x, *DISGUISE))
            hidden = F.size(F.array_intersect(veiled, abuse)).cast("double")
            masked = lambda x: x.rlike(r"[0-9@$!]") & F.translate(x, *DISGUISE).isin(ABUSE)
            times = lambda seen, test: F.when(seen > 0, F.size(F.filter(w, test))).otherwise(0)
            open_ = F.array_intersect(d["words"], abuse)
            kinds = F.size(open_) + hidden
            hits = times(F.size(open_), lambda x: x.isin(ABUSE)) + times(hidden, masked)

            def gap() -> Column:
                """The least distance of abuse to a second person: one pass that carries the last place of each."""

                def step(a: Column, x: Column) -> Column:
                    last = F.struct((a["at"] + 1).alias("at"), F.when(x.isin(ABUSE), a["at"]).otherwise(a["abuse"]).alias("abuse"), F.when(x.isin(SECOND_PERSON), a["at"]).otherwise(a["you"]).alias("you"), a["best"].alias("best"))
                    moved = lambda m: F.struct(m["at"].alias("at"), m["abuse"].alias("abuse"), m["you"].alias("you"), F.least(m["best"], F.abs(m["abuse"] - m["you"])).alias("best"))
                    return let(last, moved)

                zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("abuse"), F.lit(None).cast("int").alias("you"), F.lit(99).alias("best"))
                return F.aggregate(w, zero, step)["best"]

            learned_kinds = (F.size(F.filter(d["words"], lambda x: x.isin(learned))) if learned else F.lit(0)).cast("double")
            stem_kinds = F.size(F.array_distinct(d["stemmed"])).cast("double")
            learned_hits = times(learned_kinds, lambda x: x.isin(learned)) if learned else F.lit(0)
            seconds = times(F.size(F.array_intersect(d["words"], you)), lambda x: x.isin(SECOND_PERSON)).cast("double")
            return F.struct(
                (hits / n).alias("abuse_density"), kinds.cast("double").alias("abuse_kinds"), (learned_hits / n).alias("learned_density"), learned_kinds.alias("learned_kinds"),
                (F.size(d["stemmed"]) / n).alias("stem_density"), stem_kinds.alias("stem_kinds"), (seconds / n).alias("second_person_density"),
                F.when((F.size(open_) > 0) & (seconds > 0), gap().cast("double")).otherwise(99.0).alias("nearest_you"),
                (_chars(text, r"\p{Lu}") / F.greatest(F.lit(1.0), _chars(text, r"\p{L}"))).alias("capitals"), (_chars(text, r"(?<!\p{L})\p{Lu}{4,}+(?!\p{L})") / n).alias("shouted"),
                (_chars(text, "[!?]") / n).alias("marks"), (_chars(text, "[!?]{2,}+") / n).alias("mark_runs"),
                (_chars(text, r"\p{L}[0-9@$*!]+\p{L}") / n).alias("obfuscated"), (_chars(text, r"(\p{L})\1\1") / n).alias("drawn_out"), F.log1p(n).alias("log_words"),
            )

        return let(F.struct(F.array_distinct(w).alias("words"), _among(w, stems).alias("stemmed")), with_sets)

    return let(_words(F.lower(text)), measured)


def _ranked(rows: DataFrame, tokens: Column) -> DataFrame:
    """Tokens of the training texts with their log odds of standing in a toxic one, and the odds over their standard error."""
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    one, zero = n.get(1, 0), n.get(0, 0)
    held = rows.select("label", F.explode(tokens).alias("token")).groupBy("token").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (one - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (zero - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    low, z = min(o for o, _ in SETTINGS), min(z for _, z in SETTINGS)
    return held.where(F.col("a") >= SUPPORT).withColumn("odds", odds).withColumn("z", odds / error).where((F.col("odds") > low) & (F.col("z") > z))


def _lexicons(ranked: DataFrame) -> list[list[str]]:
    """For each setting the LEARNED tokens at most with the highest z."""
    top = lambda o, z: ranked.where((F.col("odds") > o) & (F.col("z") > z)).orderBy(F.desc("z"), "token").limit(LEARNED).collect()
    return [sorted(r.token for r in top(o, z)) for o, z in SETTINGS]


def _area(counts: dict[tuple[int, int], int]) -> float:
    """Area under the curve of a score given as (score, label) -> rows; a half without both labels."""
    one, zero = (sum(n for (_, y), n in counts.items() if y == label) for label in (1, 0))
    below = won = 0.0
    for value in sorted({v for v, _ in counts}):
        a, b = counts.get((value, 1), 0), counts.get((value, 0), 0)
        won += a * (below + b / 2)
        below += b
    return won / (one * zero) if one and zero else 0.5


def _chosen(rows: DataFrame, lexicons: list[tuple[list[str], list[str]]]) -> tuple[list[str], list[str]]:
    """The lexicon whose kinds of words and stems in a text rank these training rows best; the first of equals."""
    w = F.array_distinct(_words(F.lower("text")))
    kinds = [let(w, lambda x, k=k: F.size(F.filter(x, lambda y: y.isin(k[0]))) + F.size(_among(x, k[1])) if k[0] else F.size(_among(x, k[1]))) for k in lexicons]
    seen = rows.select("label", F.posexplode(F.array(*kinds)).alias("setting", "kinds")).groupBy("setting", "kinds", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    areas = [_area({(r.kinds, r.label): r.n for r in seen if r.setting == k}) for k in range(len(lexicons))]
    return lexicons[areas.index(max(areas))]


@dataclass
class ToxicityModel:
    learned: list[str]
    stems: list[str]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None

    def score(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs with `score` (0 to 1), which hangs on the text alone.

        Defined results: a null text counts as empty; repeated rows get the same score each; an empty table gives no rows;
        other columns stay, whatever their names, and one named score is replaced.
        """
        if self.trees is None:
            return docs.withColumn("score", F.lit(0.0))
        kept = [c for c in docs.columns if c != "score"]
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), features(text_of(text_col), self.learned, self.stems).alias("__features"))
        rated = self.trees.transform(_vectors(rows)).withColumn("__raw", vector_to_array("__probability")[1])
        level = self.curve.transform(rated) if self.curve is not None else rated.withColumn("__score", F.col("__raw"))
        mixed = (1 - UNLEVEL) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__score"))) + UNLEVEL * F.col("__raw")
        return level.select("__row", mixed.alias("__mixed")).select("__row.*", F.col("__mixed").alias("score"))


def _vectors(rows: DataFrame) -> DataFrame:
    flat = rows.select(*rows.columns, *(F.col("__features")[c].alias(f"__f_{c}") for c in FEATURES)).drop("__features")
    return VectorAssembler(inputCols=[f"__f_{c}" for c in FEATURES], outputCol="__x").transform(flat).drop(*(f"__f_{c}" for c in FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, trees: int = 20, depth: int = 3, seed: int = 5) -> ToxicityModel:
    """A model of labels (id, 0 or 1), learned from at most about train_rows of them, drawn evenly by a hash of the id.

    Three parts of the sample, by another hash, teach the lexicons, the trees and the calibration curve, so that none is fit
    on what another has seen; the trees' part also chooses the lexicon's setting.  The sample is broadcast to find its texts:
    its size is the documented bound.

    Defined results: a sample with one class only, or none, gives a model that scores 0; labels without an id, or other than
    0 and 1, and labels without a document are left out; of several labels for one id the greatest counts; null texts count
    as empty; other columns aren't read.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    share = min(1.0, train_rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    work = Scratch(docs.sparkSession, "toxicity")
    rows = work.table(text.join(F.broadcast(drawn), "id").withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(10))), "sample")
    lexicon, grown, curve = rows.where("part < 4"), rows.where("part between 4 and 7"), rows.where("part > 7")
    words = _words(F.lower("text"))
    ranked = [work.table(_ranked(lexicon, tokens), name) for tokens, name in ((F.array_distinct(words), "words"), (_stems(words), "stems"))]
    learned, stems = _chosen(grown, list(zip(*map(_lexicons, ranked), strict=True)))
    rated = lambda part: _vectors(part.select("label", features(F.col("text"), learned, stems).alias("__features")))
    train = work.table(rated(grown).withColumn("label", F.col("label").cast("double")), "train").coalesce(4).cache()
    try:
        if train.select("label").distinct().count() < 2:
            work.drop()
            return ToxicityModel(learned, stems, None, None)
        boosted = GBTClassifier(featuresCol="__x", labelCol="label", predictionCol="__predicted", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=seed)
        model = boosted.setProbabilityCol("__probability").setRawPredictionCol("__margin").fit(train)
    finally:
        train.unpersist()
    held = model.transform(rated(curve)).select(F.col("label").cast("double").alias("label"), vector_to_array("__probability")[1].alias("__raw"))
    held = work.table(held, "curve").coalesce(1)
    fitted = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__score").fit(held) if held.select("label").distinct().count() > 1 else None
    work.drop()
    return ToxicityModel(learned, stems, model, fitted)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; null where the id is."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def agreement(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """Precision, recall and Brier score on the held-out labels."""
    x = scored.where("held_out").join(labels.select(id_col, F.col(label_col).alias("label")), id_col)
    hit = (F.col("predicted") == 1) & (F.col("label") == 1)
    return x.agg((F.count_if(hit) / F.count_if(F.col("predicted") == 1)).alias("precision"), (F.count_if(hit) / F.count_if(F.col("label") == 1)).alias("recall"), F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"), F.count(F.lit(1)).alias("n"))
