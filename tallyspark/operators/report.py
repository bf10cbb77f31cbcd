"""Claim tiers: how strongly a result may be worded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import small_table

# Permitted wording per tier; the negated tiers belong to non-binding verdicts.
WORDING = {
    "A": "was binding under the specified decision rule",
    "B": "appears to have been binding",
    "C": "is consistent with a binding constraint",
    "D": "suggests (mechanism only)",
    "E": "a delay was observed (description only)",
    "X": "binding status cannot be determined",
    "PENDING": "no claim yet",
    "—": "no claim",
    "A¬": "was not binding under the specified decision rule",
    "B¬": "appears not to have been binding",
    "C¬": "is consistent with a non-binding clock",
}


def claim_tier(level: Column, verdict: Column, sign_stable: Column, rival: Column, window_tier: Column, window_setter: Column, independent: Column) -> Column:
    """Tier of the claim an episode supports.

    A rival that is not rejected caps the claim at C before A and B are considered; an
    indeterminate or unstable verdict is X; a non-binding verdict carries the negation sign.
    """
    t = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    level, verdict, rival = t(level), t(verdict), t(rival)
    strong = (rival == "Rejected") & (t(sign_stable) == "Yes") & (t(independent) == "Yes")
    seller = t(window_setter) == "Seller"
    base = (F.when(rival == "Not rejected", "C").when(strong & (t(window_tier) == "A") & ~seller, "A").when(strong & ((t(window_tier) == "B") | seller), "B").otherwise("PENDING"))
    at_top = (F.when(verdict == "", "PENDING").when((verdict == "Indeterminate") | (t(sign_stable) == "No"), "X")
              .when((verdict == "Non-binding") & (base != "PENDING"), F.concat(base, F.lit("¬"))).otherwise(base))
    return F.when(level == "Level 3", at_top).when(level.startswith("Level 2"), "D").when(level.startswith("Level 1"), "E").otherwise("—")


def claims(episodes: DataFrame, verdicts: DataFrame, key: str = "episode") -> DataFrame:
    """Tier and wording per episode; where no verdict is recorded for a top-level episode the computed one is used.

    ``episodes``: key, level, recorded_verdict, recorded_sign, rival, window_tier, window_setter, independent.
    """
    v = verdicts.select(F.col("episode").alias("_e"), F.col("verdict").alias("_v"), F.col("sign_stable").alias("_s"), F.col("indeterminate_reason").alias("_r"))
    m = episodes.join(v, F.trim(F.col(key).cast("string")) == F.col("_e"), "left")
    rec = F.trim(F.coalesce(F.col("recorded_verdict"), F.lit("")))
    use = (rec == "") & (F.col("level") == "Level 3") & F.col("_v").isNotNull()
    m = m.withColumns({"verdict": F.when(use, F.col("_v")).otherwise(rec), "sign": F.when(use, F.col("_s")).otherwise(F.col("recorded_sign")),
                       "verdict_source": F.when(use, "computed").when(rec != "", "recorded").otherwise("")})
    tier = claim_tier(F.col("level"), F.col("verdict"), F.col("sign"), F.col("rival"), F.col("window_tier"), F.col("window_setter"), F.col("independent"))
    words = small_table(episodes.sparkSession, list(WORDING.items()), "claim_tier string, wording string")
    why = F.when((F.col("verdict") == "Indeterminate") & (F.coalesce("_r", F.lit("")) != ""), F.concat(F.lit(" ("), F.col("_r"), F.lit(")"))).otherwise("")
    out = m.withColumn("claim_tier", tier).join(F.broadcast(words), "claim_tier", "left")
    return out.select(key, "level", "verdict", "verdict_source", "claim_tier", F.concat(F.coalesce("wording", F.lit("")), why).alias("permitted_wording"))
