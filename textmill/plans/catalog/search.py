"""Queries over vectors."""

from pyspark.sql import functions as F

from textmill.functions.vectors import cosine_distance
from textmill.operators import codes as co
from textmill.operators import embedding as em
from textmill.operators import lists as li
from textmill.operators import search as se
from textmill.plans.catalog.registry import query
from textmill.plans.catalog.sql import HASHED
from textmill.plans.views import dealt, view
from textmill.session import new_folder
from textmill.sources.vector_table import write_index

TEXT = "the report of the region and its reading by the people"
REFNUM1, REFNUM2 = 100003, 200007
DIM = em.HASH_DIM


def document_vectors(spark, folder):
    docs = dealt(view(spark, folder, "src_docs").select("doc_id", "content"))
    return em.embed(docs).select("doc_id", "embedding")


def label_queries(spark, folder):
    """The mean vector of every label: one query per label, made from all vectors.

    Sums are taken per label and position before the shuffle; a label has `DIM` of them.
    """
    places = view(spark, folder, "chunk_vectors").select("label", F.posexplode("embedding"))
    means = places.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda place: place.value).alias("embedding"))


def benchmark_queries(spark, folder):
    items = view(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return em.embed(items, text="text").select("query_id", "embedding")


def _rounded(found, *columns):
    return found.select(*columns, F.col("rank").cast("bigint").alias("rank"),
                        F.round("distance", 6).alias("distance"))


@query("src_docs", f"""
    with {HASHED('hashed', 'src_docs', 'doc_id', 'content')}
    select doc_id, pos, round(value, 6) as value from hashed""")
def embed_hash(spark, folder):
    places = document_vectors(spark, folder).select("doc_id", F.posexplode("embedding").alias("pos", "value"))
    return places.filter("value <> 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"),
        F.round(F.col("value").cast("double"), 6).alias("value"))


# Vectors are (key, pos, value) rows here; equal distances are ranked by key.
_LENGTHS = "select {key}, sqrt(sum(value * value)) as length from {name} group by {key}"

_DOCUMENTS = f"""
    {HASHED('docs', 'src_docs', 'doc_id', 'content')},
    doc_length as ({_LENGTHS.format(key='doc_id', name='docs')}),"""


_TOPK_TEXT = f"""
    with asked as (select 0 as query_id, '{TEXT}' as text),
    {_DOCUMENTS}
    {HASHED('q', 'asked', 'query_id', 'text')},
    q_length as ({_LENGTHS.format(key='query_id', name='q')}),
    dots as (
      select d.doc_id, sum(d.value * q.value) as dot
      from docs d join q on d.pos = q.pos group by d.doc_id),
    ranked as (
      select l.doc_id,
             round(1 - coalesce(dot, 0) / (l.length * q_length.length), 9) as distance
      from doc_length l left join dots using (doc_id), q_length)
    select * from (
      select row_number() over (order by distance, doc_id) as rank, doc_id, round(distance, 6) as distance
      from ranked)
    where rank <= 5"""


@query("src_docs", _TOPK_TEXT)
def topk_text(spark, folder):
    found = se.top_k(document_vectors(spark, folder), TEXT, 5, vector_id="doc_id")
    return _rounded(found, "doc_id")


@query("src_docs", f"""
    with found as ({_TOPK_TEXT})
    select rank, doc_id, distance, md5(content) as content_md5, url
    from found join src_docs using (doc_id)""")
def topk_rows(spark, folder):
    """The answer with the text and the URL of the rows found."""
    docs = dealt(view(spark, folder, "src_docs"))
    vectors = em.embed(docs)
    found = se.with_rows(se.top_k(vectors, TEXT, 5, vector_id="doc_id"), docs, "doc_id", "content", "url")
    return _rounded(found.withColumn("content_md5", F.md5("content")), "doc_id", "content_md5", "url")


@query("src_docs", f"""
    with {_DOCUMENTS}
    {HASHED('q', 'benchmark', 'item_id', 'text')},
    q_length as ({_LENGTHS.format(key='item_id', name='q')}),
    dots as (
      select q.item_id, d.doc_id, sum(d.value * q.value) as dot
      from docs d join q on d.pos = q.pos group by q.item_id, d.doc_id),
    ranked as (
      select q.item_id, l.doc_id,
             round(1 - coalesce(dot, 0) / (l.length * q.length), 9) as distance
      from doc_length l cross join q_length q
           left join dots on dots.doc_id = l.doc_id and dots.item_id = q.item_id)
    select * from (
      select item_id as query_id, doc_id,
             row_number() over (partition by item_id order by distance, doc_id) as rank,
             round(distance, 6) as distance
      from ranked)
    where rank <= 5""")
def topk_texts(spark, folder):
    found = se.top_k_batch(document_vectors(spark, folder), benchmark_queries(spark, folder), 5,
                           vector_id="doc_id")
    return _rounded(found, "query_id", "doc_id")


@query("chunk_vectors", """
    select a.vec_id,
           round(1 - list_dot_product(a.embedding::double[], b.embedding::double[])
                 / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]))
                    * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))), 6) as distance
    from chunk_vectors a join chunk_vectors b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, folder):
    """The distance of every vector to the one after it."""
    left = view(spark, folder, "chunk_vectors").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    distance = cosine_distance(F.col("embedding"), F.col("other"))
    return left.join(right, "vec_id").select("vec_id", F.round(distance, 6).alias("distance"))


_LABELS = """
    places as (
      select vec_id, label, generate_subscripts(embedding, 1) as pos,
             unnest(embedding)::double as value from chunk_vectors),
    means as (select label, pos, avg(value) as value from places group by label, pos),
    labels_as_lists as (
      select label as query_id, list(value order by pos) as wanted from means group by label)"""


_TOPK_BATCH = f"""
    with {_LABELS},
    ranked as (
      select query_id, vec_id,
             round(1 - list_dot_product(embedding::double[], wanted)
                   / (sqrt(list_dot_product(embedding::double[], embedding::double[]))
                      * sqrt(list_dot_product(wanted, wanted))), 9) as distance
      from chunk_vectors cross join labels_as_lists)
    select * from (
      select query_id, vec_id,
             row_number() over (partition by query_id order by distance, vec_id) as rank,
             round(distance, 6) as distance
      from ranked)
    where rank <= 10"""


@query("chunk_vectors", _TOPK_BATCH)
def topk_batch(spark, folder):
    found = se.top_k_batch(view(spark, folder, "chunk_vectors"), label_queries(spark, folder), 10,
                           vector_id="vec_id")
    return _rounded(found, "query_id", "vec_id")


@query("chunk_vectors", _TOPK_BATCH)
def topk_codes(spark, folder):
    """The same through 8-bit codes, with exact distances only for the rows that these leave open."""
    path = new_folder(spark, "codes")
    vectors = view(spark, folder, "chunk_vectors").select("vec_id", "embedding")
    co.encoded(vectors, "vec_id").write.parquet(path)
    found = co.top_k_codes(spark.read.parquet(path), vectors, label_queries(spark, folder), 10, vector_id="vec_id")
    return _rounded(found, "query_id", "vec_id")


@query("chunk_vectors", f"""
    with asked as (select 0 as query_id, '{TEXT}' as text),
    {HASHED('q', 'asked', 'query_id', 'text')},
    places as (
      select vec_id, generate_subscripts(embedding, 1) - 1 as pos, unnest(embedding)::double as value
      from chunk_vectors where refnum1 = {REFNUM1}),
    dots as (
      select p.vec_id, sum(p.value * p.value) as squares, sum(p.value * coalesce(q.value, 0)) as dot
      from places p left join q on p.pos = q.pos group by p.vec_id),
    ranked as (
      select vec_id, round(1 - dot / (sqrt(squares) * (select sqrt(sum(value * value)) from q)), 9) as distance
      from dots)
    select * from (
      select row_number() over (order by distance, vec_id) as rank, vec_id, round(distance, 6) as distance
      from ranked)
    where rank <= 5""")
def topk_filtered(spark, folder):
    found = se.top_k(view(spark, folder, "chunk_vectors"), TEXT, 5, vector_id="vec_id", refnum1=REFNUM1)
    return _rounded(found, "vec_id")


@query("chunk_vectors", f"""
    select vec_id, refnum1, refnum2 from chunk_vectors
    where refnum1 = {REFNUM1} and refnum2 = {REFNUM2} order by vec_id limit 10""")
def find_by_refnums(spark, folder):
    found = se.find_by_refnums(view(spark, folder, "chunk_vectors"), REFNUM1, REFNUM2, 10, "vec_id")
    return found.select("vec_id", "refnum1", "refnum2")


@query("chunk_vectors", """
    select refnum1, refnum2, count(*) as n_rows from chunk_vectors group by refnum1, refnum2""")
def refnum_stats(spark, folder):
    return se.refnum_statistics(view(spark, folder, "chunk_vectors"))


@query("chunk_vectors", """
    select count(*) as n_rows, count(distinct (refnum1, refnum2)) as n_pairs,
           count(distinct refnum1) as n_refnum1, count(distinct refnum2) as n_refnum2,
           min(refnum1) as min_refnum1, max(refnum1) as max_refnum1,
           min(refnum2) as min_refnum2, max(refnum2) as max_refnum2,
           count(*) filter (refnum1 is null and refnum2 is null) as n_without
    from chunk_vectors""")
def refnum_summary(spark, folder):
    return se.refnum_summary(view(spark, folder, "chunk_vectors"))


@query("chunk_vectors", """
    select vec_id, 63 as dimensions from chunk_vectors where label = 7""")
def dimension_rejects(spark, folder):
    """The vectors of one label lose their last place, so the table has to refuse them."""
    cut = F.when(F.col("label") == 7, F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding"))
    vectors = view(spark, folder, "chunk_vectors").withColumn("embedding", cut)
    return em.dimension_rejects(vectors, DIM).select("vec_id", "dimensions")


@query("chunk_vectors", _TOPK_BATCH)
def topk_lsh_everywhere(spark, folder):
    """The approximate search over all buckets is exact."""
    vectors = view(spark, folder, "chunk_vectors")
    path = new_folder(spark, "index")
    write_index(se.with_bucket(vectors.select("vec_id", "embedding")), path, "vec_id")
    near = se.approx_top_k(spark.read.parquet(path), label_queries(spark, folder), 10, share=1, vector_id="vec_id")
    return _rounded(near, "query_id", "vec_id")


def _hits(exact, near, *more):
    """Per query, how many of the exact nearest the other search found."""
    hit = near.select("query_id", exact.columns[2], F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", exact.columns[2]], "left").groupBy("query_id", *more).agg(
        F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


@query()
def topk_lsh_recall(spark, folder):
    """Hits of the approximate search among the exact ten nearest, per label. The given
    vectors are far apart (no neighbour above cosine 0.5), so nine in ten buckets are read."""
    vectors = view(spark, folder, "chunk_vectors")
    queries = label_queries(spark, folder)
    path = new_folder(spark, "index")
    write_index(se.with_bucket(vectors.select("vec_id", "embedding")), path, "vec_id")
    exact = se.top_k_batch(vectors, queries, 10, vector_id="vec_id")
    return _hits(exact, se.approx_top_k(spark.read.parquet(path), queries, 10, vector_id="vec_id"))


@query("chunk_vectors", _TOPK_BATCH)
def topk_lists_everywhere(spark, folder):
    """The search in inverted lists is exact where every list is asked."""
    path = new_folder(spark, "lists")
    li.write_lists(view(spark, folder, "chunk_vectors").select("vec_id", "embedding"), path, 16, "vec_id")
    index = li.read_lists(spark, path)
    return _rounded(li.top_k_lists(index, label_queries(spark, folder), 10, 16, "vec_id"), "query_id", "vec_id")


@query()
def topk_lists_recall(spark, folder):
    """Hits among the exact ten nearest for every twentieth document, and the share of the rows it read.

    How many lists are asked is what the table measured on rows of its own when it was written.
    """
    path = new_folder(spark, "lists")
    document_vectors(spark, folder).write.parquet(f"{path}/vectors")
    vectors = spark.read.parquet(f"{path}/vectors")
    queries = vectors.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    li.write_lists(vectors, path, 32, "doc_id")
    index = li.read_lists(spark, path)
    exact = se.top_k_batch(vectors, queries, 10, vector_id="doc_id")
    hits = _hits(exact, li.top_k_lists(index, queries, 10, vector_id="doc_id"))
    return hits.join(li.share_read(index, queries), "query_id")
