"""Company registry: candidates of many documents meet the registry in one join, then an ordered fold settles each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ids, text


def registry_hits(forms: DataFrame, registry: DataFrame) -> DataFrame:
    """read_id, place, cui, name: candidates of each read form that the registry knows, by their place among its candidates.

    forms: distinct read_id. Many documents share a form, so forms, not documents, meet the registry.
    """
    wanted = forms.select("read_id", F.posexplode(ids.id_candidates(F.col("read_id"))).alias("place", "cui"))
    return wanted.join(registry.dropDuplicates(["cui"]), "cui")


def resolve(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, cui, score, status for every document.

    docs: doc_id, header, read_id. A single hit is taken; of several, in candidate order, one takes over if its name is
    likelier by more than 0.05, or about as likely and nearer to the read form, or as near and shorter.
    """
    keys = docs.select(F.coalesce("read_id", F.lit("")).alias("read_id"), F.coalesce("header", F.lit("")).alias("header")).distinct()
    hits = registry_hits(keys.select("read_id").distinct(), registry)
    hit = F.struct("place", "cui", text.name_score(F.col("name"), F.col("header")).alias("score"), ids.digit_distance(F.col("cui"), F.col("read_id")).alias("far"))
    found = keys.join(hits, "read_id").select("read_id", "header", hit.alias("hit")).groupBy("read_id", "header").agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    def better(best, h):
        near = F.abs(h["score"] - best["score"]) <= 0.05
        take = (h["score"] > best["score"] + 0.05) | (near & (h["far"] < best["far"])) | (near & (h["far"] == best["far"]) & (F.char_length(h["cui"]) < F.char_length(best["cui"])))
        return F.when(take, h).otherwise(best)

    best = F.aggregate(F.slice("hits", F.lit(2), F.size("hits")), F.get("hits", F.lit(0)), better)
    settled = found.select("read_id", "header", best.alias("best"), (F.size("hits") == 1).alias("one"))
    own = docs.select("doc_id", F.coalesce("read_id", F.lit("")).alias("read_id"), F.coalesce("header", F.lit("")).alias("header"))
    out = own.join(settled, ["read_id", "header"], "left")
    ok = ids.company_id_ok(F.col("read_id"))
    repaired = ~ok | (F.col("best.cui") != F.col("read_id"))
    status = (
        F.when(F.col("best").isNotNull(), F.when(repaired & (F.col("one") | (F.col("best.score") < 0.5)), "confirmat_anaf_reparat").otherwise("confirmat_anaf"))
        .when(F.col("read_id") == "", "fara_cui")
        .otherwise("cui_negasit_anaf")
    )
    return out.select("doc_id", F.coalesce("best.cui", F.when(ok, F.col("read_id"))).alias("cui"), F.coalesce("best.score", F.lit(0.0)).alias("score"), status.alias("status"))
