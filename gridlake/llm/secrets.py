"""Secret scan with corpus-wide ownership, in DataFrame operations only.

Three base kinds are found in every whole text, leftmost and non-overlapping within a kind. The method
adds a fourth, `owned`: runs of 20 or more letters, digits, _ and - with upper case, lower case and
digits, kept when the same value belongs to one owner in the whole corpus. Values of all kinds are
hashed and counted by distinct repositories (documents) and owners (sources): what many owners hold is
a copied example, what one owner holds looks live. Counting goes by (value, owner, repository), then
(value, owner), then value, so map-side sums come before every shuffle; the join back to the places is
salted, as a value may hold a third of all rows.

Positions are code points, end exclusive, from the lengths of the matches and of the text between.
Null texts are empty, a null owner is one owner of its own. Repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import stage_table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs AKIA[A-Z0-9]+ of 20 characters and more
HEX = r"[0-9a-f]{24,}"
OWNED = r"[A-Za-z0-9_-]{20,}"
#: kind, pattern, group of the value, least length of the value
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("owned", OWNED, 0, 20))
BASE = KINDS[:3]
SALTS = 16
RUN = 128
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _places(text: Column, kind: int) -> Column:
    """array<struct<start, kind, end, value>> of one kind, in order."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), whole.alias("whole"), value.alias("value"))
    empty = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["whole"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        # the text after the last match has no match of its own
        return F.when(x["whole"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["out"], F.array(span).cast(f"array<{SPAN}>")).alias("out"))
        )

    # appending to an array copies it, so matches are placed in runs, and runs after one another
    first = F.sequence(F.lit(0), F.size(rows) - 1, F.lit(RUN))
    runs = F.transform(first, lambda i: F.aggregate(F.slice(rows, i + 1, F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
    begins = F.aggregate(runs, F.array(F.lit(0)), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))

    def moved(run: Column) -> Column:
        by = run["begin"]
        return F.transform(run["run"]["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    pairs = F.arrays_zip(runs.alias("run"), F.slice(begins, F.lit(1), F.size(runs)).alias("begin"))
    got = F.flatten(F.transform(pairs, moved)).cast(f"array<{SPAN}>")
    good = F.filter(got, lambda s: F.length(s["value"]) >= least)
    if kind == 3:
        good = F.filter(good, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    return F.when(text.rlike(pattern), good).otherwise(empty)


def find_places(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """row, doc_id, owner and an array of places for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    found = df.select("doc_id", "owner", *(_places(text, k).alias(name) for k, (name, *_) in enumerate(KINDS)))
    return found.withColumn("row", F.monotonically_increasing_id())


def ownership(places: DataFrame) -> DataFrame:
    """hash, n_repos and n_owners of every value."""
    each = places.select("doc_id", F.coalesce("owner", F.lit("")).alias("owner"), F.explode(F.concat(*(k[0] for k in KINDS))).alias("s"))
    each = each.select(F.xxhash64("s.value").alias("hash"), "owner", "doc_id").distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, base (places of the base kinds by start, then kind), every (with the owned ones),
    n_live and n_copied (values of the document that one owner, or more, hold)."""
    places = stage_table(find_places(docs, id_col, owner_col, text_col), "secret-places")
    base = F.sort_array(F.concat(*(k[0] for k in BASE)))
    whole = F.concat(base, F.col("owned"))
    each = places.select("row", F.explode(whole).alias("s"))
    each = each.select("row", "s", F.xxhash64("s.value").alias("hash"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    stats = ownership(places).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    held = each.join(stats, ["hash", "salt"]).groupBy("row").agg(
        F.collect_list(F.when((F.col("s.kind") == 3) & (F.col("n_owners") == 1), F.col("s"))).alias("added"),
        F.count_if(F.col("n_owners") == 1).alias("n_live"),
        F.count_if(F.col("n_owners") > 1).alias("n_copied"),
    )
    out = places.select("row", "doc_id", base.alias("base"), *(F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in BASE)).join(held, "row", "left")
    added = F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)"))
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "base", *(f"n_{k[0]}" for k in BASE), F.sort_array(F.concat("base", added)).alias("every"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("every")).alias("spans"), "n_live", "n_copied")


def _sql_kind(kind: int) -> str:
    name, pattern, group, least = KINDS[kind]
    p = pattern.replace("'", "''")
    more = " and regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')" if kind == 3 else ""
    return f"""select r, doc_id, owner, start, {kind} as kind, start + length(w) as stop, v from (
      select r, doc_id, owner, unnest(ws) as w, unnest(vs) as v,
        unnest(list_transform(range(1, len(ws) + 1), lambda i: cast(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:i-1], lambda g: length(g))), 0) as bigint))) as start
      from (select r, doc_id, owner, regexp_extract_all(t, '{p}', 0) as ws, regexp_extract_all(t, '{p}', {group}) as vs, string_split_regex(t, '{p}') as gs from d)
    ) where length(v) >= {least}{more}"""


ORACLE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(text, '') as t from documents),
s as ({" union all ".join(_sql_kind(k) for k in range(4))}),
o as (select v, count(distinct owner) as n_owners from s group by v),
k as (select s.*, n_owners, case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'owned' end || ':' || start || ':' || stop as x from s join o using (v)),
g as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
  string_agg(x, ',' order by start, kind) filter (kind < 3) as b, string_agg(x, ',' order by start, kind) filter (kind < 3 or n_owners = 1) as e,
  count(*) filter (n_owners = 1) as n_live, count(*) filter (n_owners > 1) as n_copied from k group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256,
  coalesce(e, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join g using (r)
"""
