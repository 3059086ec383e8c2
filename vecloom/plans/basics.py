"""Queries of the column functions, aggregates, set operations, sources and text preparation."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import ann_candidates
from ..functions import text as tx, vectors as vf
from ..functions.embed import HashingEmbedder, embed_texts, to_half
from ..operators.recall import overlap
from ..operators.search import hide_muted, root_post
from ..session import SharedFiles, workspace
from ..sources import files
from .base import SQL, config, first_query, muted, vectors
from .registry import Registry, Tables

QUERIES = Registry()
_WITH = "with " + SQL


# -- vector functions ------------------------------------------------------------------------------------------
@QUERIES.query("vf01_cosine_distance", _WITH + " select post_id, chunk_number, round(list_cosine_distance(e, (select e from q)), 6) as d from pv")
def vf01(t: Tables) -> DataFrame:
    return vectors(t).select("post_id", "chunk_number", F.round(vf.cosine_distance_to("embedding", first_query(t)[1]), 6).alias("d"))


@QUERIES.query("vf02_negative_inner_product", _WITH + " select post_id, chunk_number, round(-list_inner_product(e, (select e from q)), 5) as d from pv")
def vf02(t: Tables) -> DataFrame:
    return vectors(t).select("post_id", "chunk_number", F.round(vf.negative_inner_product(F.col("embedding"), vf.literal(first_query(t)[1])), 5).alias("d"))


@QUERIES.query("vf03_slice_distance", _WITH + " select post_id, chunk_number, round(list_cosine_distance(e[1:16], (select e[1:16] from q)), 6) as d from pv")
def vf03(t: Tables) -> DataFrame:
    return vectors(t).select("post_id", "chunk_number", F.round(vf.cosine_distance_to(vf.subvector("embedding", 1, 16), first_query(t)[1][:16]), 6).alias("d"))


@QUERIES.query(
    "vf04_projection",
    _WITH + ", m as (select list(e order by post_id, chunk_number) m from (select * from pv order by post_id, chunk_number limit 4)) select post_id, chunk_number, list_transform(m, lambda r: round(list_inner_product(r, e), 5)) as y from pv, m",
)
def vf04(t: Tables) -> DataFrame:
    v = vectors(t)
    m = [r.embedding for r in v.orderBy("post_id", "chunk_number").select("embedding").limit(4).collect()]
    return v.select("post_id", "chunk_number", F.transform(vf.project("embedding", m), lambda x: F.round(x, 5)).alias("y"))


@QUERIES.query("vf06_text_round_trip", _WITH + " select post_id, chunk_number, true as same from pv")
def vf06(t: Tables) -> DataFrame:
    v = vectors(t)
    return v.select("post_id", "chunk_number", (vf.from_text(vf.to_text("embedding")).cast("array<float>") == F.col("embedding")).alias("same"))


@QUERIES.query("vf06_half_precision")
def vf06_half(t: Tables) -> DataFrame:
    return to_half(vectors(t).select("post_id", "chunk_number", "embedding"), "embedding")


@QUERIES.query("vf07_dims", "select len(embedding) as dims, count(*) as n from posts_vectors where embedding is not null group by 1")
def vf07(t: Tables) -> DataFrame:
    return t.posts_vectors.filter("embedding is not null").groupBy(vf.dims("embedding").cast("long").alias("dims")).agg(F.count(F.lit(1)).alias("n"))


# -- filters, joins --------------------------------------------------------------------------------------------
@QUERIES.query("flt01_root_posts", "select id from hive_posts where root_id = id or root_id = 0")
def flt01(t: Tables) -> DataFrame:
    return t.hive_posts.filter(root_post()).select("id")


@QUERIES.query("flt05_muted_hidden", _WITH + " select id from hive_posts p where not exists (select 1 from mute where observer_id = 2 and muted_id = p.author_id)")
def flt05(t: Tables) -> DataFrame:
    return hide_muted(t.hive_posts, muted(t), 2).select("id")


@QUERIES.query("flt08_sequence_range", "select post_id, chunk_number, sync_seq from posts_vectors where sync_seq > 200 and sync_seq <= 500")
def flt08(t: Tables) -> DataFrame:
    return t.posts_vectors.filter((F.col("sync_seq") > 200) & (F.col("sync_seq") <= 500)).select("post_id", "chunk_number", "sync_seq")


@QUERIES.query("flt10_null_safe", "select count(*) as n from (select distinct * from post_data) a join (select distinct * from post_data) b on a.post_id = b.post_id where a.number_of_tokens is distinct from b.last_vectors_block")
def flt10(t: Tables) -> DataFrame:
    d = t.post_data.distinct()
    return d.alias("a").join(d.alias("b"), F.col("a.post_id") == F.col("b.post_id")).filter(~F.col("a.number_of_tokens").eqNullSafe(F.col("b.last_vectors_block"))).agg(F.count(F.lit(1)).alias("n"))


@QUERIES.query("jn04_posts_without_vectors", "select id from hive_posts p left join (select distinct post_id from posts_vectors) v on v.post_id = p.id where v.post_id is null")
def jn04(t: Tables) -> DataFrame:
    return t.hive_posts.join(t.posts_vectors.select(F.col("post_id").alias("id")), "id", "left_anti").select("id")


@QUERIES.query("jn05_had_vectors", "select p.id, exists (select 1 from posts_vectors v where v.post_id = p.id) as had_vectors from hive_posts p")
def jn05(t: Tables) -> DataFrame:
    had = t.posts_vectors.select(F.col("post_id").alias("id")).distinct().withColumn("had", F.lit(True))
    return t.hive_posts.join(had, "id", "left").select("id", F.coalesce("had", F.lit(False)).alias("had_vectors"))


@QUERIES.query(
    "jn08_full_outer",
    "select coalesce(a.post_id, b.post_id) as post_id, a.s as seq, b.b as block from (select post_id, max(sync_seq) s from posts_vectors group by 1) a full join (select post_id, max(last_vectors_block) b from post_data group by 1) b on a.post_id = b.post_id",
)
def jn08(t: Tables) -> DataFrame:
    a = t.posts_vectors.groupBy("post_id").agg(F.max("sync_seq").alias("seq"))
    return a.join(t.post_data.groupBy("post_id").agg(F.max("last_vectors_block").alias("block")), "post_id", "full")


@QUERIES.query("jn16_names", "select p.id as post_id, a.name as author, k.permlink from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id")
def jn16(t: Tables) -> DataFrame:
    from ..operators.feed import names_of_posts

    return names_of_posts(t.hive_posts, t.hive_accounts, t.hive_permlink_data)


# -- aggregates, windows ---------------------------------------------------------------------------------------
@QUERIES.query("ag05_distinct_counts", "select count(distinct post_id) as posts, count(distinct (post_id, chunk_number)) as chunks from posts_vectors")
def ag05(t: Tables) -> DataFrame:
    return t.posts_vectors.agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("post_id", "chunk_number").alias("chunks"))


@QUERIES.query("ag11_ordered_names", "select author_id, id // 1024 as part, to_json(list(id order by id)) as ids from hive_posts group by author_id, id // 1024")
def ag11(t: Tables) -> DataFrame:
    """In parts by range of the unique id, so that no list outgrows 1024, whatever share of all posts an author has."""
    return t.hive_posts.groupBy("author_id", F.floor(F.col("id") / 1024).cast("int").alias("part")).agg(F.to_json(F.sort_array(F.collect_list("id"))).alias("ids"))


@QUERIES.query("wn04_best_chunk", _WITH + ", d as (select post_id, chunk_number, round(list_cosine_distance(e, (select e from q)), 6) d from pv) select post_id, arg_min(chunk_number, (d, chunk_number)) as chunk_number, min(d) as similarity from d group by post_id")
def wn04(t: Tables) -> DataFrame:
    from ..operators.search import best_chunks, rounded_distance

    return best_chunks(vectors(t).select("post_id", "chunk_number", rounded_distance("embedding", first_query(t)[1]).alias("similarity")))


@QUERIES.query("wn05_name_resolution", "select author_id, permlink_id, arg_max(id, (counter_deleted = 0)::int::bigint * 10000000000 + id) as post_id from hive_posts group by 1, 2")
def wn05(t: Tables) -> DataFrame:
    from ..operators.rebase import prefer_live

    return prefer_live(t.hive_posts, ["author_id", "permlink_id"])


@QUERIES.query("wn10_ordinality", "select p.id, u.i::int as pos, u.x::int as x from hive_posts p, (select unnest([0, 1, 2]) i, unnest([30, 10, 20]) x) u")
def wn10(t: Tables) -> DataFrame:
    return t.hive_posts.select("id", F.posexplode(F.array(F.lit(30), F.lit(10), F.lit(20))).alias("pos", "x"))


@QUERIES.query("tk02_candidate_counts", "select l as limit_, greatest(least(l * 5, 50000), 1000) as posts, greatest(least(l * 10, 50000), 1000) as authors from (values (1), (100), (500), (1000), (20000)) v(l)")
def tk02(t: Tables) -> DataFrame:
    c = config()
    return t.spark.createDataFrame([(n, ann_candidates(n, 5, c), ann_candidates(n, 10, c)) for n in (1, 100, 500, 1000, 20000)], "limit_ int, posts int, authors int")


@QUERIES.query("tk11_first_chunk", _WITH + " select post_id, min(chunk_number) as chunk_number, round(arg_min(e[1], chunk_number), 5) as x from pv group by 1")
def tk11(t: Tables) -> DataFrame:
    return vectors(t).groupBy("post_id").agg(F.min("chunk_number").alias("chunk_number"), F.round(F.min_by(F.element_at("embedding", 1).cast("double"), "chunk_number"), 5).alias("x"))


@QUERIES.query("tk05_full_and_stubs", _WITH + ", d as (select id, row_number() over (order by id) n from hive_posts limit 100) select id, n <= 10 as whole from d where n <= 20")
def tk05(t: Tables) -> DataFrame:
    top = t.hive_posts.orderBy("id").limit(20)
    return top.select("id", (F.row_number().over(W.orderBy("id")) <= 10).alias("whole"))


# -- sets ------------------------------------------------------------------------------------------------------
@QUERIES.query("st03_except_union", "select post_id from (select post_id from posts_vectors except select post_id from post_data where number_of_tokens < 100) union select id from hive_posts where counter_deleted > 0")
def st03(t: Tables) -> DataFrame:
    return t.posts_vectors.select("post_id").subtract(t.post_data.filter("number_of_tokens < 100").select("post_id")).union(t.hive_posts.filter("counter_deleted > 0").select("id")).distinct()


@QUERIES.query("st04_intersections", "select author_id, len(list_intersect(list(id), list(permlink_id)))::int as common from hive_posts group by 1")
def st04(t: Tables) -> DataFrame:
    some = lambda c: t.hive_posts.select("author_id", F.col(c).alias("id"))
    return overlap(some("id"), some("permlink_id"), ["author_id"], "id")


@QUERIES.query("st05_symmetric_difference", "select post_id, '<' as side from (select post_id from post_data except all select distinct post_id from post_data) union all select post_id, '>' from (select distinct post_id from post_data except all select post_id from post_data)")
def st05(t: Tables) -> DataFrame:
    a, b = t.post_data.select("post_id"), t.post_data.select("post_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("<")).union(b.exceptAll(a).withColumn("side", F.lit(">")))


# -- text ------------------------------------------------------------------------------------------------------
def _docs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text").filter("text is not null")


def _replace(pattern: str, by: str = "", options: str = "g") -> str:
    return f"select doc_id, regexp_replace(text, '{pattern}', '{by}', '{options}') as text from documents where text is not null"


@QUERIES.query("sf01_control_characters", _replace(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"))
def sf01(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.strip_control("text").alias("text"))


@QUERIES.query("sf02_html_unescape")
def sf02(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.unescape_html("text").alias("text"))


@QUERIES.query("sf03_html_text")
def sf03(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.strip_html("text").alias("text"))


@QUERIES.query("sf04_link_titles", _replace(r"\[([^\]]+)\]\([^\)]+\)|!\[\]\([^)]*\)|!\S+\.(?:jpg|jpeg|png|gif)", r"\1", "gi"))
def sf04(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.link_titles("text").alias("text"))


@QUERIES.query("sf05_images_urls", _replace(r"(?:!\[.*?\]\(.*?\)|https?://[^\t\n\x0b\f\r ]+)", "", "gi"))
def sf05(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.drop_images_urls("text").alias("text"))


@QUERIES.query("sf06_base64", _replace(r"data:image\/[a-zA-Z]+;base64,[A-Za-z0-9+/=]+"))
def sf06(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.drop_base64("text").alias("text"))


@QUERIES.query("sf07_unwanted", "select doc_id, regexp_replace(replace(text, chr(13), ''), '(?m)Posted via.*$|[*_]+', '', 'g') as text from documents where text is not null and text not like '%' || chr(8232) || '%'")
def sf07(t: Tables) -> DataFrame:
    plain = _docs(t).filter(~F.col("text").contains(" ")).withColumn("text", F.regexp_replace("text", "\r", ""))
    return plain.select("doc_id", tx.drop_unwanted("text").alias("text"))


@QUERIES.query("sf07_unwanted_all_rows", "select doc_id, regexp_replace(text, '(?m)Posted via.*$|[*_]+', '', 'g') as text from documents where text is not null")
def sf07_all(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.drop_unwanted("text").alias("text"))


@QUERIES.query("sf08_collapsed", r"select doc_id, trim(regexp_replace(text, '[\t\n\x0b\f\r ]+', ' ', 'g'), ' ') as text from documents where text is not null")
def sf08(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.collapse("text").alias("text"))


@QUERIES.query(
    "sf09_language_guess",
    r"select doc_id, case when regexp_matches(text, '[\x{AC00}-\x{D7AF}]') then 'ko' when regexp_matches(text, '[\x{3040}-\x{30FF}]') then 'ja' when regexp_matches(text, '[\x{4E00}-\x{9FFF}]') then 'zh' else 'en' end as lang from documents where text is not null",
)
def sf09(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.guess_language("text").alias("lang"))


@QUERIES.query("sf10_plain_sentences")
def sf10(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.size(tx.split_cjk("text")).alias("cjk"), F.size(tx.split_universal("text")).alias("universal"))


@QUERIES.query("sf12_post_text", "select doc_id, source || '.' || chr(10) || chr(10) || text as text from documents")
def sf12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.post_text("source", "text").alias("text"))


@QUERIES.query("sf14_truncated", "select doc_id, left(text, 25) as text from documents")
def sf14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.truncated("text", 25).alias("text"))


@QUERIES.query("sf16_links", "select p.id, 'https://posts.example/@' || a.name || '/' || k.permlink as link from hive_posts p join hive_accounts a on a.id = p.author_id join hive_permlink_data k on k.id = p.permlink_id")
def sf16(t: Tables) -> DataFrame:
    rows = t.hive_posts.join(t.hive_accounts.select(F.col("id").alias("author_id"), "name"), "author_id").join(t.hive_permlink_data.select(F.col("id").alias("permlink_id"), "permlink"), "permlink_id")
    return rows.select("id", tx.post_url("https://posts.example", "name", "permlink").alias("link"))


@QUERIES.query("tx01_cleaned")
def tx01(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", tx.clean("text").alias("text"))


@QUERIES.query("tx03_chunked")
def tx03(t: Tables) -> DataFrame:
    return tx.chunk_posts(t.documents.select("doc_id", tx.clean("text").alias("text")), "doc_id", "text", 64, 0.15, "passage: ", 20)


@QUERIES.query("df01_iso_times", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, (epoch(timestamp '2024-02-01') - floor(epoch(ts)))::bigint as age from events")
def df01(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), (F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("age"))


@QUERIES.query("jf01_json_fields", "select event_id, (props->>'k')::int as k, json_exists(props, '$.k') as has_k from events")
def jf01(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.map_contains_key(F.from_json("props", "map<string,string>"), "k").alias("has_k"))


@QUERIES.query("jf02_json_objects", "select id, to_json({'author': name, 'n': id}) as j from hive_accounts")
def jf02(t: Tables) -> DataFrame:
    return t.hive_accounts.select("id", F.to_json(F.struct(F.col("name").alias("author"), F.col("id").alias("n"))).alias("j"))


# -- sources ---------------------------------------------------------------------------------------------------
def _dumped(t: Tables) -> DataFrame:
    """The whole table after it has been written and read."""
    path = workspace(t.spark, "csv") + "/old_vectors.csv"
    files.write_csv(t.legacy_vectors_raw, path)
    return files.read_csv(t.spark, path, files.OLD_VECTORS)


@QUERIES.query("src04_csv_round_trip", "select author, permlink, chunk_number, sync_seq, length(embedding)::int as n from legacy_vectors_raw where permlink not like '%' || chr(10) || '%' and author not like '%' || chr(10) || '%' and embedding <> '' and author = trim(author, E' \\t\\n') and permlink = trim(permlink, E' \\t\\n')")
def src04(t: Tables) -> DataFrame:
    edge = lambda c: F.col(c) == F.trim(c, F.lit(" \t\n"))
    plain = edge("author") & edge("permlink") & ~F.col("author").contains("\n") & ~F.col("permlink").contains("\n")
    return _dumped(t).filter(plain & (F.col("embedding") != "")).select("author", "permlink", "chunk_number", "sync_seq", F.length("embedding").alias("n"))


@QUERIES.query("src04_csv_all_rows", "select author, permlink, chunk_number, sync_seq, embedding from legacy_vectors_raw")
def src04_all(t: Tables) -> DataFrame:
    return _dumped(t).select("author", "permlink", "chunk_number", "sync_seq", "embedding")


@QUERIES.query("src06_status_line", "select '577013fd' as sync_uuid, 100::int as tail_seq, 2::int as skipped, 80000000::int as block")
def src06(t: Tables) -> DataFrame:
    path = workspace(t.spark, "status")
    files.write_status(t.spark, path, files.StatusLine("577013fd", 100, 2, 80000000))
    return t.spark.read.schema("sync_uuid string, tail_seq int, skipped int, block int").option("sep", "|").csv(f"{path}/old_status.txt")


@QUERIES.query("src08_json_matrix", "select i::int as row_idx, [i, i + 0.5]::float[] as row_vec from range(3) r(i)")
def src08(t: Tables) -> DataFrame:
    path = workspace(t.spark, "matrix")
    SharedFiles(t.spark, path).write("m.json", json.dumps([[i, i + 0.5] for i in range(3)]))
    return files.matrix_from_json(t.spark, f"{path}/m.json")


@QUERIES.query("src09_matrix_files", "select unnest(['.npy', '.json', '.json.gz']) as ext, 2::bigint as components, 2::bigint as dims, 10.0::double as total")
def src09(t: Tables) -> DataFrame:
    rows = []
    with tempfile.TemporaryDirectory() as d:  # on the driver only
        for ext in (".npy", ".json", ".json.gz"):
            files.save_matrix([[1.0, 2.0], [3.0, 4.0]], os.path.join(d, "m" + ext))
            m = files.load_matrix(files.find_matrix("m" + ext, [d]))
            rows.append((ext, *m.shape, float(m.sum())))
    return t.spark.createDataFrame(rows, "ext string, components long, dims long, total double")


@QUERIES.query("src13_neighbour_files", "select name as q_author, 'p' as q_permlink, 0::int as q_chunk_number, name as author, 'x' as permlink, 1::int as chunk_number, 0.5::double as distance, 1::int as rank from hive_accounts")
def src13(t: Tables) -> DataFrame:
    path = workspace(t.spark, "neighbours")
    rows = t.hive_accounts.select(F.col("name").alias("q_author"), F.lit("p").alias("q_permlink"), F.lit(0).alias("q_chunk_number"), F.col("name").alias("author"), F.lit("x").alias("permlink"), F.lit(1).alias("chunk_number"), F.lit(0.5).alias("distance"), F.lit(1).alias("rank"))
    files.write_neighbours(rows, path)
    return files.read_neighbours(t.spark, path)


@QUERIES.query("src16_embedded")
def src16(t: Tables) -> DataFrame:
    return embed_texts(_docs(t), "text", HashingEmbedder(64)).select("doc_id", "embedding")
