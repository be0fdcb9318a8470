"""Snapshots, diffs, manual overrides and sentence edits."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["uid", "s", "e", "surface"]


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """KEY, old_id, old_tier, new_id, new_tier, kind (added, removed, pid_changed, tier_changed). Keys may be
    null. One full outer join on the key."""
    o = old.select(*[F.col(k).alias(f"o_{k}") for k in KEY], F.col("id").alias("old_id"), F.col("tier").alias("old_tier"), F.lit(1).alias("in_old"))
    n = new.select(*KEY, F.col("id").alias("new_id"), F.col("tier").alias("new_tier"), F.lit(1).alias("in_new"))
    on = [n[k].eqNullSafe(o[f"o_{k}"]) for k in KEY]
    both = n.join(o, on[0] & on[1] & on[2] & on[3], "full_outer")
    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_id").eqNullSafe(F.col("new_id")), "pid_changed").when(~F.col("old_tier").eqNullSafe(F.col("new_tier")), "tier_changed")
    pick = [F.when(F.col("in_new").isNull(), F.col(f"o_{k}")).otherwise(F.col(k)).alias(k) for k in KEY]
    return both.withColumn("kind", kind).filter("kind is not null").select(*pick, "old_id", "old_tier", "new_id", "new_tier", "kind")


def retained(snapshots: DataFrame, keep: int) -> DataFrame:
    """Rows of the latest `keep` snapshots. The ids are distinct first: a short list."""
    ids = snapshots.select("snapshot_id").distinct().orderBy(F.desc("snapshot_id")).limit(keep)
    return snapshots.join(ids, "snapshot_id", "left_semi")


def overridden(mentions: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides: uid, s, e, surface, nth (among like surfaces), action, new_id. An override meets the mention
    at its exact span, else the nth of its surface. drop removes, reassign changes the id (the tier stays), keep
    only marks. Adds overridden (0/1)."""
    m = mentions.withColumn("of", F.row_number().over(Window.partitionBy("uid", "surface").orderBy("s", "e")))
    o = overrides.select("uid", F.col("s").alias("o_s"), F.col("e").alias("o_e"), "surface", F.col("nth").alias("o_nth"), "action", F.col("new_id").alias("o_id"))
    exact = m.join(o, (m.uid == o.uid) & (m.surface == o.surface) & (m.s == o.o_s) & (m.e == o.o_e)).select(m.uid, m.surface, "s", "e", "action", "o_id", F.lit(1).alias("exact"))
    # only overrides without an exact meeting go by place
    rest = o.join(exact.select("uid", "surface", F.col("s").alias("o_s"), F.col("e").alias("o_e")), ["uid", "surface", "o_s", "o_e"], "left_anti")
    byplace = m.join(rest, (m.uid == rest.uid) & (m.surface == rest.surface) & (m.of == rest.o_nth)).select(m.uid, m.surface, "s", "e", "action", "o_id", F.lit(0).alias("exact"))
    # of overrides that meet one mention the exact one holds, then the last by action and id
    clash = exact.unionByName(byplace).groupBy("uid", "surface", "s", "e").agg(F.max(F.struct("exact", "action", "o_id")).alias("x"))
    hit = clash.select("uid", "surface", "s", "e", "x.action", "x.o_id")
    out = m.drop("of").join(hit, ["uid", "surface", "s", "e"], "left").filter("action is null or action <> 'drop'")
    return out.withColumns({"id": F.when(F.col("action") == "reassign", F.col("o_id")).otherwise(F.col("id")), "overridden": F.col("action").isNotNull().cast("int")}).drop("action", "o_id")


def override_states(overrides: DataFrame, mentions: DataFrame) -> DataFrame:
    """What has become of each override: mentions are those of all kinds, united."""
    m = mentions.groupBy(*KEY).agg(F.max("id").alias("now"))  # the same of two claims at each run
    o = overrides.join(m, KEY, "left")
    state = F.when(F.col("action") == "drop", F.when(F.col("now").isNull(), "applied").otherwise("pending")).when(F.col("now").isNull(), "lost").when(F.col("action") == "keep", "applied").when(F.col("now") == F.col("new_id"), "applied").otherwise("pending")
    return o.withColumn("state", state)


def edit_text(sentences: list[dict], edits: list[dict]) -> list[dict]:
    """D12 on one chapter: sentences (uid, para_seq, seq, text) in order, edits (edit_id, uid, action, at) in order.
    Each edit is applied once."""
    out = [dict(s, status=s.get("status") or "active", edits=list(s.get("edits") or [])) for s in sentences]
    for edit in edits:
        k = next((i for i, s in enumerate(out) if s["uid"] == edit["uid"]), None)
        if k is None or edit["edit_id"] in out[k]["edits"]:
            continue
        here = out[k]
        if edit["action"] == "dead":
            here["status"] = "dead"
        elif edit["action"] == "merge":
            follow = next((s for s in out[k + 1 :] if s["para_seq"] == here["para_seq"] and s["status"] == "active"), None)
            if follow is None:
                continue
            here["text"] += follow["text"]
            follow.update(text="", status="merged", edits=[*follow["edits"], edit["edit_id"]])
        elif edit["action"] == "split":
            at = int(edit["at"] or 0)
            if not 0 < at < len(here["text"]):
                continue
            uid = hashlib.md5(f"{here['uid']}|split|{at}".encode()).hexdigest()[:12]
            out.insert(k + 1, dict(here, uid=uid, seq=here["seq"] + 0.5, text=here["text"][at:], edits=[edit["edit_id"]]))
            here["text"] = here["text"][:at]
        else:
            continue
        here["edits"].append(edit["edit_id"])
    return out


def replayed(sents: DataFrame, edits: DataFrame) -> DataFrame:
    """Always from the pristine sentences, so replaying twice changes nothing and a revoked edit is undone. Only
    chapters with edits are grouped; the others pass through."""
    # new names: both sides of the cogroup may come from the same sentences
    at = sents.select(F.col("uid").alias("of_uid"), F.col("chapter").alias("of_chapter"))
    e = edits.select("edit_id", F.col("uid").alias("of_uid"), "action", "at").join(at, "of_uid").select("edit_id", "of_uid", "action", "at", "of_chapter")
    busy = e.select(F.col("of_chapter").alias("chapter")).distinct()

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = edit_text(left.sort_values(["para_seq", "seq"]).to_dict("records"), right.rename(columns={"of_uid": "uid"}).sort_values("edit_id").to_dict("records"))
        return pd.DataFrame([(s["uid"], s["chapter"], s["para_seq"], float(s["seq"]), s["text"], s["status"]) for s in got], columns=["uid", "chapter", "para_seq", "seq", "text", "status"])

    s = sents.select("uid", "chapter", "para_seq", "seq", "text")
    done = s.join(busy, "chapter", "left_semi").groupBy("chapter").cogroup(e.groupBy("of_chapter")).applyInPandas(one, "uid string, chapter long, para_seq int, seq double, text string, status string")
    rest = s.join(busy, "chapter", "left_anti").select("uid", "chapter", F.col("para_seq").cast("int").alias("para_seq"), F.col("seq").cast("double").alias("seq"), "text", F.lit("active").alias("status"))
    return done.unionByName(rest)


def reconciled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def kept_uids(corpus: DataFrame, old: DataFrame) -> DataFrame:
    """The corpus's own uid, else the one that stood at the position before, else that of the position."""
    from inkspan.functions.text import short_id

    pos = ["chapter", "para_seq", "seq"]
    o = old.select(*pos, F.col("uid").alias("old_uid"))
    return corpus.join(o, pos, "left").withColumn("uid", F.coalesce("uid", "old_uid", short_id(*map(F.col, pos)))).drop("old_uid")


def renamed(rows: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """Ids replaced in every column that refers to them. mapping: old, new."""
    for c in columns:
        rows = rows.join(mapping.select(F.col("old").alias(c), F.col("new").alias(f"__{c}")), c, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return rows
