"""Seeded sampling and splitting."""

from pyspark.sql import functions as F

from admitflow.operators import sampling
from admitflow.session import cut_lineage
from workload.registry import query

SEED = 11
_RANK = "row_number() over (order by md5(id::varchar || ':11')) - 1"
_CLASS_RANK = "row_number() over (partition by y order by md5(id::varchar || ':11')) - 1"
_DRAW = "('0x' || substr(md5(draw::varchar || ':11:draw'), 1, 15))::bigint"


@query(
    "split_exact",
    f"""
    select id, y, case when r < floor(n * 0.3::double) then 'test'
      when r < floor(n * 0.3::double) + floor(n * 0.1::double) then 'validation' else 'train' end as split
    from (select id, y, {_RANK} as r, count(*) over () as n from labelled)""",
)
def split_exact(t):
    return sampling.split_exact(t.labelled.select("id", "y"), "id", SEED, 0.3, 0.1)


_STRATIFIED = f"""
    select id, y, case when r < quota then 'test' else 'train' end as split
    from (select id, y, {_CLASS_RANK} as r from labelled) join (
      select y, base + (case when place <= want - sum(base) over () then 1 else 0 end) as quota from (
        select y, floor(exact)::bigint as base, want, row_number() over (order by exact - floor(exact) desc, y) as place
        from (select y, want, want * n / total as exact from (
          select y, n, sum(n) over () as total, ceil(sum(n) over () * 0.1::double) as want from (select y, count(*) as n from labelled group by 1)))))
      using (y)"""


@query("split_stratified", _STRATIFIED)
def split_stratified(t):
    return sampling.split_stratified(t.labelled.select("id", "y"), "id", "y", SEED, 0.1)


@query(
    "split_three_way",
    f"""
    select id, y, case when r < tested then 'test' when r < tested + ceil((n - tested) * (0.1::double / 0.9::double)) then 'validation' else 'train' end as split
    from (select id, y, r, n, ceil(n * 0.3::double) as tested from (select id, y, {_RANK} as r, count(*) over () as n from labelled))""",
)
def split_three_way(t):
    return sampling.split_three_way(t.labelled.select("id", "y"), "id", SEED, 0.3, 0.1, 0.8)


@query(
    "kfold_assign",
    f"""
    select id, y, (select count(*) from range(1, 5) k where r >= floor(n * k.range / 5))::int as fold
    from (select id, y, {_CLASS_RANK} as r, count(*) over (partition by y) as n from labelled)""",
)
def kfold_assign(t):
    return sampling.kfold_assign(t.labelled.select("id", "y"), "id", "y", SEED, 5)


def _ratio_sql(source: str, ratio: float) -> str:
    """Ratio sample of (id, y) rows; negatives drawn again when they are short."""
    return f"""
    with src as ({source}),
    quota as (select least(floor(n / ({ratio}::double + 1)), p) as pos, n - p as have from (
      select count(*) as n, count(*) filter (y = 1) as p from src)),
    size as (select pos, floor({ratio}::double * pos) as neg, have from quota),
    ranked as (select id, y, {_CLASS_RANK} as r, row_number() over (order by md5(id::varchar || ':11')) - 1 as g from src),
    once as (select id, y, id as draw from ranked, size where (y = 1 and r < pos) or (y = 0 and neg <= have and r < neg)),
    aimed as (select draw, {_DRAW} % have as r from (select id as draw, have from ranked, size where neg > have and g < neg)),
    again as (select x.id, x.y, d.draw from aimed d join ranked x on x.y = 0 and x.r = d.r)
    select id, y, draw from once union all select id, y, draw from again"""


@query("sample_ratio", _ratio_sql("select id, y from labelled", 3.0))
def sample_ratio(t):
    return sampling.ratio_sample(t.labelled.select("id", "y"), "id", "y", SEED, 3.0)


@query("sample_ratio_short", _ratio_sql("select id, 1 - y as y from labelled", 3.0))
def sample_ratio_short(t):
    flipped = t.labelled.select("id", (1 - F.col("y")).alias("y"))
    return sampling.ratio_sample(flipped, "id", "y", SEED, 3.0)


@query(
    "generate_samples",
    f"""
    with split as (select id, y, case when r < floor(n * 0.3::double) then 'test'
        when r < floor(n * 0.3::double) + floor(n * 0.1::double) then 'validation' else 'train' end as split
      from (select id, y, {_RANK} as r, count(*) over () as n from labelled)),
    size as (select least(floor(n / 4.0::double), p) as pos from (select count(*) as n, count(*) filter (y = 1) as p from split where split = 'train')),
    ranked as (select id, y, {_CLASS_RANK} as r from split where split = 'train')
    select id, y, 'train' as split, id as draw from ranked, size where r < case when y = 1 then pos else floor(3.0::double * pos) end
    union all select id, y, split, id as draw from split where split <> 'train'""",
)
def generate_samples(t):
    return sampling.generate_samples(t.labelled.select("id", "y"), "id", "y", SEED, 3.0, 0.3, 0.1)


@query(
    "oversample_minority",
    f"""
    with ranked as (select id, y, {_CLASS_RANK} as r from labelled),
    sizes as (select count(*) filter (y = 1) as few from labelled)
    select id, y, null::bigint as draw from labelled
    union all
    select m.id, m.y, d.draw from (
      select draw, {_DRAW} % few as r from (select id as draw, few from ranked, sizes where y = 0 and r >= few)) d
      join ranked m on m.y = 1 and m.r = d.r""",
)
def oversample_minority(t):
    return sampling.oversample_minority(t.labelled.select("id", "y"), "id", "y", SEED)


@query(
    "undersample_majority",
    f"""
    select id, y from (select id, y, {_CLASS_RANK} as r from labelled), (select count(*) filter (y = 1) as few from labelled)
    where y = 1 or r < floor(few / 0.55::double)""",
)
def undersample_majority(t):
    return sampling.undersample_majority(t.labelled.select("id", "y"), "id", "y", SEED, 0.55)


@query("class_weights", "select y, count(*) as n, 1.0::double / count(*) as weight from labelled group by 1")
def class_weights(t):
    return sampling.class_weights(t.labelled, "y")


@query(
    "weighted_bootstrap",
    f"""
    with ranked as (select id, y, {_CLASS_RANK} as r, count(*) over (partition by y) as n from labelled),
    draws as (select id as draw, ('0x' || substr(md5(id::varchar || ':11:class'), 1, 15))::bigint % 2 as y from labelled),
    aimed as (select d.y, d.draw, {_DRAW} % c.n as r from draws d join (select y, count(*) as n from labelled group by 1) c on c.y = d.y)
    select d.y::int as y, d.draw, x.id from aimed d join ranked x on x.y = d.y and x.r = d.r""",
)
def weighted_bootstrap(t):
    return sampling.weighted_bootstrap(t.labelled.select("id", "y"), "id", "y", SEED).select("y", "draw", "id")


@query(
    "resample_balance",
    """
    select 'original' as training_set, y, count(*) as "count" from labelled group by 1, 2
    union all
    select 'oversampled', y, max(count(*)) over () from labelled group by 1, 2""",
)
def resample_balance(t):
    rows = t.labelled.select("id", "y")
    over = sampling.oversample_minority(rows, "id", "y", SEED)
    return sampling.balance_table("y", original=rows, oversampled=over)


@query(
    "draws_by_split",
    """
    select y, max(n) as draws, true as rows_exist, true as spread from (
      select 0 as y, (select count(*) from labelled where y = 0) as n union all select 1, (select count(*) from labelled where y = 0))
    group by 1""",
)
def draws_by_split(t):
    """Both classes drawn with replacement to the majority's size, where the rows lie: totals, and how many different rows came."""
    rows = t.labelled.select("id", "y")
    size = sampling.class_counts(rows, "y")
    drawn = cut_lineage(sampling.draw_rows(rows, "y", {0: size[0], 1: size[0]}, SEED), "draws")
    known = drawn.join(rows.withColumn("known", F.lit(1)), ["id", "y"], "left")
    found = known.groupBy("y").agg(F.count(F.lit(1)).alias("draws"), F.count("known").alias("_known"), F.count_distinct("id").alias("_rows"))
    have = F.when(F.col("y") == 0, F.lit(size[0])).otherwise(F.lit(size[1]))
    # n (1 - (1 - 1/n)^m) different rows are to be expected.
    expected = have * (1 - F.pow(1 - 1 / have, F.col("draws")))
    spread = F.abs(F.col("_rows") - expected) < 6 * F.sqrt(expected) + 1
    return found.select("y", "draws", (F.col("_known") == F.col("draws")).alias("rows_exist"), spread.alias("spread"))
