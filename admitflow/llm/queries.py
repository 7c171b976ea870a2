"""The registered queries of this folder: each operator on its whole table, with the digest columns of its results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.llm import bpe, chat, collocations, neighbours, packing, prefix_hash, prefix_trie, rank_bpe, secrets, simhash, site_tree, toxicity, warc
from admitflow.llm.common import held_out, table, text_of
from admitflow.session import cut_lineage
from admitflow.sources.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    scored = toxicity.score_texts(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


@query("op2_secrets")
def op2_secrets(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    letters = secrets.Letters.of(secrets.letter_counts(docs))
    scanned = docs.select("doc_id", secrets.scan_column(letters, F.col("text")).alias("s")).select("doc_id", "s.base", "s.found")
    scanned = cut_lineage(scanned, "secret-candidates")
    cuts = secrets.fit_cuts(scanned, secrets.RATE)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *map(count, secrets.KINDS[:3]),
        F.sha2(secrets.span_text("base").cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(secrets.all_spans(cuts)).alias("spans"),
    )


@query("op3_site_tree")
def op3_site_tree(spark, folder):
    return site_tree.extract(table(spark, folder, "pages"))


@query("op4_chat")
def op4_chat(spark, folder):
    talks = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    return chat.read_back(cut_lineage(chat.windows(talks.unionByName(extra), TOKENIZER), "chat-windows"))


@query("op5_prefix_hash")
def op5_prefix_hash(spark, folder):
    return prefix_hash.edited_pairs(table(spark, folder, "documents").select("doc_id", "text"))


@query("op6_bpe")
def op6_bpe(spark, folder):
    """Encode with the merge queue, decode what came out in the same pass, and give the digests of both."""
    coded = bpe.encode_texts(table(spark, folder, "documents"), TOKENIZER, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op7_warc",
    """
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
           case when strlen(coalesce(html, '')) < 1000 or page_id = owner then 'response' else 'revisit' end as record_type,
           case when strlen(coalesce(html, '')) >= 1000 and page_id <> owner then owner end as refers_to
    from (select *, max(page_id) over (partition by coalesce(html, '')) as owner from pages)""",
)
def op7_warc(spark, folder):
    path = new_path(spark, "warc")
    warc.write_archive(table(spark, folder, "pages"), path)
    facts = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    records = warc.read_archive(spark, path, facts)
    return records.select(
        warc.page_of(warc.header_value("header", "WARC-Record-ID")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        warc.header_value("header", "WARC-Type").alias("record_type"),
        warc.page_of(warc.header_value("header", "WARC-Refers-To")).alias("refers_to"),
    )


@query("op8_neighbours")
def op8_neighbours(spark, folder):
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_simhash")
def op9_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


@query("op10_packing")
def op10_packing(spark, folder):
    """Runs carry their ids; the digest is taken before they are stored, so the plan moves narrow rows only."""
    runs = packing.token_runs(table(spark, folder, "documents"), TOKENIZER)
    narrow = runs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.place_runs(cut_lineage(narrow, "runs"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op13_rank_bpe")
def op13_rank_bpe(spark, folder):
    """Encode by ranks, decode what came out in the same pass, and give the digests of both."""
    coded = rank_bpe.encode_texts(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query(
    "op11_collocations",
    r"""
    with pieces as (
        select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) as piece
        from documents),
    told as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
    places as (select lang, w, unnest(range(1, len(w) + 1)) as i from told),
    grams as (select lang, w[i:i + k - 1] as g from places, range(1, 4) r(k) where i + k - 1 <= len(w)),
    f as (select lang, g, count(*) as f from grams group by all),
    totals as (select lang, sum(f) as n from f where len(g) = 1 group by lang),
    candidates as (select lang, g, f as a from f where len(g) > 1 and f >= 10),
    cuts as (
        select c.lang, c.g, c.a, k, x.f as l, y.f as r,
               1000000::hugeint * c.a::hugeint * c.a::hugeint // (x.f::hugeint * y.f::hugeint) as score
        from (select *, unnest(range(1, len(g))) as k from candidates) c
        join f x on x.lang = c.lang and x.g = c.g[1:k] join f y on y.lang = c.lang and y.g = c.g[k + 1:]),
    scored as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
    inside as (
        select distinct lang, g[j:j + 1] as g, max(a) as most from (select *, unnest([1, 2]) as j from candidates where len(g) = 3) group by all),
    kept as (
        select s.* from scored s left join inside i on i.lang = s.lang and i.g = s.g
        where i.most is null or 100 * i.most < 50 * s.a),
    ranked as (
        select *, array_to_string(g, ' ') as phrase,
               row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank
        from kept)
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
    from ranked join totals using (lang) where rank <= 2000""",
)
def op11_collocations(spark, folder):
    return collocations.mine(table(spark, folder, "documents"))


# crc32 of a decimal number in SQL: one step per character, eight bits a step.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}::varchar, ''), lambda x: ord(x)::bigint)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, k: xor(s >> 1, (s & 1) * 3988292384::bigint))), 4294967295::bigint)"""


@query(
    "op12_prefix_trie",
    f"""
    with told as (
        select conv_id as c, coalesce(text, '') as x, coalesce(role, '') as r,
               row_number() over (partition by conv_id order by turn nulls first,
                                  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
        from conversations where conv_id is not null),
    own as (select c, list({{'r': r, 'x': x}} order by pos) as turns from told group by c),
    heads as (select c, turns, {CRC32.format("c")} % 9 as h from own),
    whole as (
        select a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) as s
        from heads a left join own b on b.c = a.c - a.c % 5),
    passed as (select c, d, s[1:d] as p, len(s) = d as last from (select *, unnest(range(len(s) + 1)) as d from whole)),
    nodes as (
        select p, d, min(c) as conv_id, count(*) as n_convs, coalesce(strlen(p[-1].x), 0) as n_bytes,
               sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where last), '')) as ends_sha256
        from passed group by p, d),
    linked as (
        select n.*, u.conv_id as parent_conv_id
        from nodes n left join nodes u on n.d > 0 and u.d = n.d - 1 and u.p = n.p[1:n.d - 1]),
    children as (select p[1:d - 1] as q, count(*) as n_children from nodes where d > 0 group by 1),
    valued as (
        select k.*, coalesce(n_children, 0) as n_children, (n_children is null)::int as leaf, (n_convs - 1) * n_bytes as saved
        from linked k left join children on q = k.p),
    lifted as (select p[1:j] as q, sum(leaf) as n_leaves, sum(saved) as saved_tokens
               from (select *, unnest(range(d + 1)) as j from valued) group by 1)
    select conv_id::bigint as conv_id, d::bigint as depth, parent_conv_id::bigint as parent_conv_id, n_convs::bigint as n_convs,
           n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, ends_sha256
    from valued join lifted on q = p""",
)
def op12_prefix_trie(spark, folder):
    turns = prefix_trie.turns_in_order(table(spark, folder, "conversations"))
    rebuilt, convs = prefix_trie.with_shared_openings(cut_lineage(turns, "turns-in-order"))
    return prefix_trie.trie(cut_lineage(rebuilt, "rebuilt-turns"), convs)
