"""State tables: every write takes the table as it is and gives the table as it will be, for a new version of its folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def replace_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose keys the new rows have (nulls equal nulls), and the new rows."""
    k = rows.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    same = F.lit(True)
    for c in keys:
        same = same & table[c].eqNullSafe(k[f"_{c}"])
    return table.join(k, same, "left_anti").unionByName(rows)


def compare_and_set(table: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], active: Column | None = None) -> DataFrame:
    """The table with the columns of the updates whose keys all agree, where `active` holds; `updated` tells which rows changed."""
    u = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False)) & (active if active is not None else F.lit(True))
    rest = [c for c in table.columns if c not in columns]
    return table.join(u, keys, "left").select(*rest, *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns], hit.alias("updated"))


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table and those of the rows whose keys it doesn't have; of rows with equal keys the first by all columns."""
    new = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in table.columns if c not in keys])).alias("_r")).select(*keys, "_r.*")
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def save_manifest(manifests: DataFrame, incoming: DataFrame, promote: bool) -> DataFrame:
    """manifests(project, version, status, is_current) with the incoming rows: a promoted one is its project's only current one, and a write that doesn't promote never changes a current row."""
    i = incoming.select("project", "version", F.col("status").alias("_status"))
    both = manifests.join(i, ["project", "version"], "full")
    led = i.select("project").distinct().withColumn("_led", F.lit(promote))
    rows = both.join(led, "project", "left")
    comes, was = F.col("_status").isNotNull(), F.coalesce("is_current", F.lit(False))
    current = F.when(comes & F.lit(promote), True).when(F.coalesce("_led", F.lit(False)), False).otherwise(was)
    status = F.when(comes & (F.lit(promote) | ~was), F.col("_status")).otherwise(F.col("status"))
    return rows.select("project", "version", status.alias("status"), current.alias("is_current"))


def activate(manifests: DataFrame, targets: DataFrame) -> DataFrame:
    """manifests in which targets(project, version) are current, each alone in its project."""
    t = targets.select("project", F.col("version").alias("_v"))
    return manifests.join(t, "project", "left").select("project", "version", "status", F.when(F.col("_v").isNotNull(), F.col("version") == F.col("_v")).otherwise(F.col("is_current")).alias("is_current"))


def prune_manifests(manifests: DataFrame, previous: DataFrame) -> DataFrame:
    """The current manifests and those of previous(project, version)."""
    kept = previous.select("project", "version").withColumn("_kept", F.lit(True))
    return manifests.join(kept, ["project", "version"], "left").where(F.col("is_current") | F.col("_kept").isNotNull()).drop("_kept")


def latest_state(log: DataFrame, key: str, order: str, allowed: dict[str, tuple[str, ...]], stretch: int = 100_000) -> DataFrame:
    """(key, state, rejected): the last state of each key in an append-only log, steps that `allowed` doesn't have counted and passed over.

    allowed[None-like ""] names the first states. A step is judged by the last state that was taken. order is a whole
    number, of which no two steps of a key have the same: the steps of each `stretch` of it are folded by themselves from every state there is,
    and a key's stretches then one after the other, so that no group holds more than `stretch` steps, however long a log is.
    """
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to])
    states = sorted({"", *allowed, *(t for to in allowed.values() for t in to)})

    def fold(s: Column, x: Column) -> Column:
        ok = F.array_contains(pairs, F.concat(s["state"], F.lit(">"), x))
        return F.struct(F.when(ok, x).otherwise(s["state"]).alias("state"), (s["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"))

    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, "state"))), lambda x: x["state"])
    each = log.withColumn("_at", F.floor(F.col(order) / stretch)).groupBy(key, "_at").agg(steps.alias("steps"))
    # where a stretch leads from each state, and how many steps it rejects on the way
    ways = [F.struct(F.lit(s).alias("start"), F.aggregate("steps", F.struct(F.lit(s).alias("state"), F.lit(0).alias("rejected")), fold).alias("end")) for s in states]
    ends = each.select(key, F.struct("_at", F.array(*ways).alias("ways")).alias("way"))

    def follow(s: Column, x: Column) -> Column:
        end = F.get(F.filter(x["ways"], lambda w: w["start"] == s["state"]), F.lit(0))["end"]
        return F.struct(end["state"].alias("state"), (s["rejected"] + end["rejected"]).alias("rejected"))

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("rejected"))
    return ends.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list("way")), start, follow).alias("r")).select(key, "r.state", "r.rejected")


def cascade_delete(tables: dict[str, DataFrame], keys: dict[str, str], gone: DataFrame, via: dict[str, tuple[str, str, str]]) -> dict[str, DataFrame]:
    """The tables without what belongs to gone(id): by each table's key column, or by way of another table: via[name] = (own column, the other table, its id)."""
    out = {}
    for name, df in tables.items():
        if name in keys:
            out[name] = df.join(gone.select(F.col("id").alias(keys[name])), keys[name], "left_anti")
        else:
            own, other, other_id = via[name]
            dead = tables[other].join(gone.select(F.col("id").alias(keys[other])), keys[other], "left_semi").select(F.col(other_id).alias(own))
            out[name] = df.join(dead, own, "left_anti")
    return out


def begin_turns(turns: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv, turn, action, attempt) for asked(conv, turn, hash) against turns(conv, turn, hash, state, attempt).

    begin a new turn, replay a completed one, resume a failed or cancelled one with one attempt more, wait for one that
    runs; another hash for the same turn is a mismatch. The same request twice counts once.
    """
    a = asked.groupBy("conv", "turn").agg(F.min("hash").alias("asked"), F.count_distinct("hash").alias("kinds"))
    rows = a.join(turns, ["conv", "turn"], "left")
    action = F.when((F.col("kinds") > 1) | (F.col("hash").isNotNull() & (F.col("hash") != F.col("asked"))), "mismatch").when(F.col("state").isNull(), "begin").when(F.col("state") == "Completed", "replay").when(F.col("state").isin("Failed", "Cancelled"), "resume").otherwise("wait")
    return rows.select("conv", "turn", action.alias("action"), F.when(action == "begin", 1).when(action == "resume", F.col("attempt") + 1).otherwise(F.col("attempt")).cast("int").alias("attempt"))


def queue_states(events: DataFrame, keys: list[str], order: str, current: Column, retries: int = 2) -> DataFrame:
    """(keys, state, attempts): each job of an event log(keys, kind): queued, running, done, failed (after `retries` more attempts), retrying; dropped where its version isn't current."""
    ended = events.groupBy(*keys).agg(F.max_by("kind", order).alias("last"), F.count_if(F.col("kind") == "failed").alias("fails"), F.count_if(F.col("kind") == "started").alias("attempts"), F.max(current).alias("current"))
    state = F.when(~F.col("current"), "dropped").when(F.col("last") == "done", "done").when((F.col("last") == "failed") & (F.col("fails") > retries), "failed").when(F.col("last") == "failed", "retrying").when(F.col("last") == "started", "running").otherwise("queued")
    return ended.select(*keys, state.alias("state"), "attempts")


def prewarm(reports: DataFrame, most: int = 3) -> DataFrame:
    """Of the largest `most` reports (id, tier, members, state) of the first tier, those without a finished summary: the limit comes before the filter."""
    return reports.where("tier = 'C0'").orderBy(F.desc("members"), "id").limit(most).where("state is null or state not in ('Completed', 'Running')").select("id")


def recent_progress(events: DataFrame, key: str, time: str, now: Column, hours: int = 1) -> DataFrame:
    """The newest event of each key, of those no older than `hours`."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("r")).select(key, "r.*")
    return last.where(F.col(time).cast("timestamp") >= now - F.make_dt_interval(hours=F.lit(hours)))


def current_run(events: DataFrame, key: str, run: str) -> DataFrame:
    """The events of each key's newest run; those of older runs are stale."""
    newest = events.groupBy(key).agg(F.max(run).alias(run))
    return events.join(newest, [key, run], "left_semi")


def numbered(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The events with their sequence in each key, from 1."""
    return events.withColumn("sequence", F.row_number().over(W.partitionBy(key).orderBy(*order)))


def merge_fragments(df: DataFrame, seq: str, columns: list[str], locations: str | None = None) -> DataFrame:
    """Edges of several fragments as one: each column's last value that isn't null, the last occurrence count, and the last locations that aren't empty.

    Without a locations column they are left alone.
    """
    by = F.col(seq)
    out = [F.max_by("occurrence_count", by).alias("occurrence_count"), *[F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns]]
    if locations:
        out.append(F.max_by(locations, F.when(F.size(locations) > 0, by)).alias(locations))
    return df.groupBy("type", "src", "dst").agg(*out)


def add_up_counts(df: DataFrame) -> DataFrame:
    """Edges whose occurrence counts (1 at least each) add up."""
    return df.groupBy("type", "src", "dst").agg(F.sum(F.greatest(F.coalesce("occurrence_count", F.lit(1)), F.lit(1))).alias("occurrence_count"))


def merge_declared(df: DataFrame, keys: list[str], seq: str, kind: str, declared: Column, columns: list[str]) -> DataFrame:
    """One row a key: last values that aren't null, but the kind of the last declaration wherever there is one."""
    order = F.struct(declared.cast("int"), F.col(seq))
    return df.groupBy(*keys).agg(F.max_by(kind, F.when(F.col(kind).isNotNull(), order)).alias(kind), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns])


def whole_row_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: the last as a whole, nulls included."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def ingest(raw: DataFrame, column: str, vocabulary: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the vocabulary's spelling, rows whose value it doesn't have) of a raw column, whatever its case."""
    spelling = F.create_map(*[F.lit(x) for v in vocabulary for x in (v.lower(), v)])
    rows = raw.withColumn("_known", F.try_element_at(spelling, F.lower(column)))
    return rows.where("_known is not null").withColumn(column, F.col("_known")).drop("_known"), rows.where("_known is null").drop("_known")


def source_fingerprint(sources: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row: the hash of all configured sources in order, their fields joined by NUL; null fields are empty."""
    row = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return sources.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower(order).alias("o"), order, row.alias("r")))), lambda x: x["r"]), "\x00"), 256).alias("fingerprint"))


def verify_snapshot(pinned: DataFrame, found: DataFrame, path: str, digest: str, most: int = 10) -> DataFrame:
    """The first `most` paths whose content isn't what was pinned, and how many there are."""
    from .merge import snapshot_diff

    changed = snapshot_diff(pinned, found, path, digest)
    return changed.orderBy(path).limit(most).crossJoin(changed.agg(F.count("*").alias("changes")))  # one row


def first_markers(files: DataFrame, path: str, markers: dict[str, str], seq: str) -> DataFrame:
    """(kind, folder, seq): the folders that hold a marker file, each kind and folder once, the first by seq."""
    name, folder = F.lower(F.regexp_extract(path, r"([^/]+)$", 1)), F.regexp_replace(path, r"/?[^/]+$", "")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for k, v in markers.items() for x in (v.lower(), k)]), name)
    return files.select(kind.alias("kind"), folder.alias("folder"), seq).where("kind is not null").groupBy("kind", "folder").agg(F.min(seq).alias(seq))


def choose_one(names: list[str], selected: str | None) -> str:
    """The only name, or the selected one of several; an error without any, or without a match."""
    if not names:
        raise ValueError("there is nothing to choose from")
    if len(names) == 1:
        return names[0]
    hit = [n for n in names if selected is not None and n.lower() == selected.lower()]
    if not hit:
        raise ValueError("several to choose from: " + ", ".join(sorted(names)))
    return hit[0]
