"""Reading, writing, stages and matrices."""

from pyspark.sql import functions as F

from admitflow.functions import vectors
from admitflow.sources import matrix, tables
from workload.registry import query


@query("scan_project", "select l_orderkey, l_partkey, l_quantity from lineitem")
def scan_project(t):
    return tables.read_table(t.spark, f"{t.folder}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query("parquet_roundtrip", "select o_orderkey, o_orderdate, o_totalprice from orders")
def parquet_roundtrip(t):
    path = tables.new_path(t.spark, f"{t.tag}_parquet_roundtrip")
    tables.write_parquet(t("orders").select("o_orderkey", "o_orderdate", "o_totalprice"), path)
    return tables.read_parquet(t.spark, path)


@query("csv_roundtrip", "select o_orderkey, o_orderpriority, o_totalprice, o_orderdate from orders")
def csv_roundtrip(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    path = tables.new_path(t.spark, f"{t.tag}_csv_roundtrip")
    tables.write_csv(df, path)
    return tables.read_csv(t.spark, path, df.schema)


@query(
    "feature_matrix",
    """
    select o_orderkey, p.pos, p.value from (
      select o_orderkey, unnest([
        {'pos': 0, 'value': o_totalprice},
        {'pos': 1, 'value': o_custkey::double},
        {'pos': 2, 'value': case when o_orderstatus = 'F' then 1.0::double else 0.0::double end}]) as p
      from orders)""",
)
def feature_matrix(t):
    df = t("orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), "o_totalprice", "o_custkey"
    )
    rows = matrix.to_matrix(df, "o_orderkey", "y")
    return rows.select("o_orderkey", F.posexplode("row").alias("pos", "value"))


@query(
    "matrix_split_xy",
    """
    select vec_id, label::double as y, (generate_subscripts(embedding, 1) - 1)::int as pos,
           unnest(embedding)::double as x
    from embeddings""",
)
def matrix_split_xy(t):
    row = F.concat(F.transform("embedding", lambda v: v.cast("double")), F.array(F.col("label").cast("double")))
    split = matrix.split_xy(t("embeddings").select("vec_id", row.alias("row")))
    return split.select("vec_id", "y", F.posexplode("x").alias("pos", "x"))


@query("stage_reuse", "select o_orderpriority, count(*) as n, max(o_totalprice) as top from orders group by 1")
def stage_reuse(t):
    def build():
        return t("orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))

    name = f"{t.tag}_stage_reuse"
    tables.stage(t.spark, name, build, reuse=True)
    return tables.stage(t.spark, name, build, reuse=True)


@query(
    "argmax_label",
    """
    select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int as best from embeddings""",
)
def argmax_label(t):
    return t("embeddings").select("vec_id", vectors.argmax("embedding").alias("best"))


@query(
    "label_tail_max",
    """
    select vec_id, list_max(embedding[-4:])::double as last4, list_max(embedding[33:64])::double as upper
    from embeddings""",
)
def label_tail_max(t):
    return t("embeddings").select(
        "vec_id",
        vectors.tail_max("embedding", 4).cast("double").alias("last4"),
        vectors.upper_half_max("embedding").cast("double").alias("upper"),
    )


@query(
    "sigmoid_threshold",
    """
    select vec_id, round(p, 6) as p, case when p >= 0.5 then 1 else 0 end as chosen from (
      select vec_id, 1.0::double / (1.0::double + exp(-(embedding[1]::double * 4))) as p from embeddings)""",
)
def sigmoid_threshold(t):
    p = vectors.sigmoid(F.element_at("embedding", 1).cast("double") * 4)
    df = t("embeddings").select("vec_id", p.alias("p"))
    return df.select("vec_id", F.round("p", 6).alias("p"), vectors.at_least("p").alias("chosen"))


@query(
    "flip_noise",
    """
    select vec_id, pos, round(case when ('0x' || substr(md5(vec_id::varchar || ':' || pos::varchar || ':11'), 1, 15))::bigint
                                 < 115292150460684704 then x else 1.0::double - x end, 6) as x
    from (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as pos, unnest(embedding)::double + 0.5::double as x
          from embeddings)""",
)
def flip_noise(t):
    unit = F.transform("embedding", lambda v: v.cast("double") + 0.5)
    df = t("embeddings").select("vec_id", unit.alias("x"))
    noised = df.select("vec_id", vectors.flip_noise("x", "vec_id", 0.1, 11).alias("x"))
    return noised.select("vec_id", F.posexplode("x").alias("pos", "x")).select("vec_id", "pos", F.round("x", 6).alias("x"))
