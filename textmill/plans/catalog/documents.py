"""Queries over messages, paths and texts."""

from pyspark.sql import functions as F

from textmill.functions import metadata as md
from textmill.functions import refnums as rn
from textmill.functions import urls
from textmill.functions.text import meaningful_words, preview
from textmill.operators import embedding as em
from textmill.operators import with_once
from textmill.operators.chunking import batch_plan, chunk_documents, pack_chunks, split_paragraphs
from textmill.operators.spread import paragraph_rows, spread_chunks
from textmill.plans.catalog.registry import query
from textmill.plans.catalog.sql import CHUNKS, HASHED, MAX_WORDS, MIN_WORDS, NORMAL_URL, REFNUMS, TYPE, WORDS
from textmill.plans.ingest import classified, not_blank_rows
from textmill.plans.views import dealt, view
from textmill.session import new_folder
from textmill.sources.files import scan_text_dir
from textmill.sources.messages import load_content as with_content
from textmill.sources.messages import missing_content, with_url, with_url_compat

INGEST_MS = 1700000000000


@query("messages", """
    select msg_id, url from (
      select msg_id, case when json_valid(body) then json_extract_string(body, '$.url') end as url
      from messages) parsed
    where trim(url) <> ''""")
def extract_url(spark, folder):
    found = view(spark, folder, "messages").select("msg_id", urls.extract_url(F.col("body")).alias("url"))
    return found.filter("url is not null")


@query("compat_messages", f"""
    with fields as (
      select msg_id, body,
             case when json_valid(body) then json_extract_string(body, '$.fileUrl') end as a,
             case when json_valid(body) then json_extract_string(body, '$.url') end as b,
             case when json_valid(body) then json_extract_string(body, '$.file_url') end as c,
             case when json_valid(body) then json_extract_string(body, '$.content') end as inline
      from compat_messages),
    found as (
      select msg_id, body, inline,
             coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''),
                      nullif(regexp_extract(body, '^\\s*Processed file:\\s*(\\S+)', 1), ''),
                      nullif(regexp_extract(body, '^\\s*([A-Za-z][A-Za-z0-9+.-]*://\\S+)\\s*$', 1), '')
             ) as url
      from fields)
    select msg_id, {NORMAL_URL} as url,
           md5(case when url is null then coalesce(inline, body) end) as inline_md5
    from found where url is not null or trim(body) <> ''""")
def extract_url_compat(spark, folder):
    found = with_url_compat(view(spark, folder, "compat_messages"))
    return found.select("msg_id", "url", F.md5("inline_content").alias("inline_md5"))


_WORK = f"""
    work as (
      select msg_id, {NORMAL_URL} as url from (
        select msg_id, case when json_valid(body) then json_extract_string(body, '$.url') end as url
        from messages) parsed
      where trim(url) <> ''),
    files as (select doc_id, content, {NORMAL_URL} as url from src_docs)"""


@query("messages", f"""
    with {_WORK}
    select msg_id, url, length(content) as n_chars, md5(content) as content_md5
    from work left join files using (url)""")
def load_content(spark, folder):
    messages = with_url(view(spark, folder, "messages"))
    loaded = with_content(messages, view(spark, folder, "src_docs"))
    return loaded.select("msg_id", "url", F.length("content").cast("bigint").alias("n_chars"),
                         F.md5("content").alias("content_md5"))


@query("messages", f"""
    with {_WORK}
    select msg_id, url from work
    where url not in (select url from files where doc_id in (select doc_id from labels))""")
def load_content_missing(spark, folder):
    """Here the files that exist are those of labelled documents."""
    messages = with_url(view(spark, folder, "messages"))
    labelled = view(spark, folder, "labels").select("doc_id").distinct()
    files = view(spark, folder, "src_docs").join(labelled, "doc_id", "left_semi")
    return missing_content(messages, files).select("msg_id", "url")


@query("src_docs", f"""
    select doc_id, contains(url, '/webhdfs/') as webhdfs, {NORMAL_URL} as url from src_docs""")
def normalize_url(spark, folder):
    return view(spark, folder, "src_docs").select(
        "doc_id", urls.is_webhdfs(F.col("url")).alias("webhdfs"), urls.normalize_url(F.col("url")).alias("url"))


@query("src_docs", """
    select doc_id, replace(replace(url, '-', '%2520'), '%2520', '%20') as url from src_docs""")
def fix_double_encoding(spark, folder):
    encoded = F.replace(F.col("url"), F.lit("-"), F.lit("%2520"))
    return view(spark, folder, "src_docs").select("doc_id", urls.fix_double_encoding(encoded).alias("url"))


@query("src_docs edge_docs", """
    with every as (select doc_id, url from src_docs union all select doc_id, url from edge_docs)
    select doc_id, url,
           split_part(list_extract(string_split(url, '/'), -1), '?', 1) as name_for_refnum,
           nullif(regexp_extract(split_part(url, '?', 1), '/([^/]+)$', 1), '') as name_for_type
    from every""")
def filenames(spark, folder):
    every = view(spark, folder, "src_docs").select("doc_id", "url").unionByName(
        view(spark, folder, "edge_docs"))
    return every.select("doc_id", "url", urls.filename_for_refnum(F.col("url")).alias("name_for_refnum"),
                        urls.filename_for_type(F.col("url")).alias("name_for_type"))


@query("src_docs edge_docs", f"""
    with every as (select doc_id, url from src_docs union all select doc_id, url from edge_docs)
    select doc_id, url, {TYPE} as document_type from every""")
def document_type(spark, folder):
    every = view(spark, folder, "src_docs").select("doc_id", "url").unionByName(
        view(spark, folder, "edge_docs"))
    return every.withColumn("document_type", urls.document_type(F.col("url")))


def _parsed(docs):
    pair = rn.parse_refnums(urls.filename_for_refnum(F.col("url")))
    return docs.withColumn("pair", pair).select("doc_id", "url", "pair.refnum1", "pair.refnum2")


@query("src_docs", f"with {REFNUMS('src_docs')} select doc_id, url, refnum1, refnum2 from parsed")
def parse_refnums(spark, folder):
    return _parsed(view(spark, folder, "src_docs"))


@query("edge_docs", f"with {REFNUMS('edge_docs')} select doc_id, url, refnum1, refnum2 from parsed")
def parse_refnums_edge(spark, folder):
    return _parsed(view(spark, folder, "edge_docs"))


@query("src_docs", f"""
    with {REFNUMS('src_docs')}
    select doc_id, {TYPE} as document_type,
           case when {TYPE} <> 'reference' then coalesce(refnum1, 100001) end as refnum1,
           case when {TYPE} <> 'reference' then coalesce(refnum2, 200001) end as refnum2
    from parsed""")
def resolve_refnums(spark, folder):
    return classified(view(spark, folder, "src_docs")).select(
        "doc_id", "document_type", "refnum1", "refnum2")


@query("src_docs", f"""
    with {REFNUMS('src_docs')},
    typed as (
      select *, {TYPE} as t, coalesce(refnum1, 100001) as r1, coalesce(refnum2, 200001) as r2
      from parsed)
    select doc_id, '{INGEST_MS}' as "timestamp",
           case when t in ('policy', 'unknown') then cast(r1 as varchar) else 'N/A' end as refnum1,
           case when t in ('policy', 'unknown') then cast(r2 as varchar) else 'N/A' end as refnum2,
           case when t in ('reference', 'information') then 'information' else 'N/A' end as doctype,
           case when t = 'unknown' then 'unknown' else 'N/A' end as "documentType",
           url as "sourcePath",
           case t when 'policy' then 4 when 'unknown' then 5 else 3 end as n_keys
    from typed""")
def build_metadata(spark, folder):
    docs = classified(view(spark, folder, "src_docs"))
    made = with_once(docs, "metadata", md.build_metadata(
        F.col("document_type"), F.col("refnum1"), F.col("refnum2"), F.col("url"), F.lit(INGEST_MS)))
    keys = ("timestamp", "refnum1", "refnum2", "doctype", "documentType", "sourcePath")
    return made.select(
        "doc_id", *[md.metadata_value(F.col("metadata"), key).alias(key) for key in keys],
        F.size(F.json_object_keys("metadata")).alias("n_keys"))


@query("src_docs", f"""
    with {REFNUMS('src_docs')}
    select doc_id, url,
           'refnum1 must be a 6-digit integer (100000-999999), got: 1' as error
    from parsed where {TYPE} = 'policy' and refnum1 is null""")
def policy_rejects(spark, folder):
    """With defaults out of range, since valid ones never reject."""
    docs = classified(view(spark, folder, "src_docs"), defaults=(1, 2))
    error = rn.refnum_error(F.col("document_type"), F.col("refnum1"), F.col("refnum2"))
    return docs.select("doc_id", "url", error.alias("error")).filter("error is not null")


@query("", "select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages")
def uri_host(spark, folder):
    return view(spark, folder, "pages").select("page_id", urls.uri_host(F.col("url")).alias("host"))


@query("src_docs", f"select doc_id, len({WORDS('content')}) as n_words from src_docs", name="meaningful_words")
def count_words(spark, folder):
    docs = dealt(view(spark, folder, "src_docs"))
    return docs.select("doc_id", meaningful_words(F.col("content")).cast("bigint").alias("n_words"))


@query("threads", f"""
    select conv_id, turn, len({WORDS('text')}) as n_words,
           case when length(text) > 100 then substr(text, 1, 100) || '...' else text end as preview
    from threads""")
def turn_words(spark, folder):
    text = F.col("text")
    return view(spark, folder, "threads").select(
        "conv_id", "turn", meaningful_words(text).cast("bigint").alias("n_words"),
        preview(text).alias("preview"))


@query("compat_messages", """
    select msg_id, length(body) as n_chars from compat_messages
    where regexp_replace(body, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') <> ''""")
def blank_filter(spark, folder):
    kept = not_blank_rows(view(spark, folder, "compat_messages"), "body")
    return kept.select("msg_id", F.length("body").cast("bigint").alias("n_chars"))


@query("src_docs", f"""
    with {CHUNKS('src_docs')}
    select doc_id, i - 1 as pos, md5(part) as paragraph_md5 from parts""")
def paragraphs(spark, folder):
    docs = dealt(view(spark, folder, "src_docs"))
    parts = docs.select("doc_id", F.posexplode(split_paragraphs(F.col("content"))).alias("pos", "part"))
    return parts.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                        F.md5("part").alias("paragraph_md5"))


def _chunk_rows(chunks):
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                         F.col("n_words").cast("bigint").alias("n_words"),
                         F.md5("content").alias("content_md5"))


@query("src_docs", f"""
    with recursive {CHUNKS('src_docs')}
    select doc_id, chunk_no, n_words, md5(content) as content_md5 from chunks""", name="chunk_documents")
def chunks_of_documents(spark, folder):
    docs = dealt(view(spark, folder, "src_docs"))
    return _chunk_rows(chunk_documents(docs, max_words=MAX_WORDS, min_words=MIN_WORDS))


@query("", """
    select md5(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) as content_md5, 'txt' as ending, 1 as n_files
    from documents group by doc_id % 8""")
def scan_text_folder(spark, folder):
    """A folder of text files, each of an eighth of the documents; a file of another kind is not read."""
    path = new_folder(spark, "texts")
    docs = view(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # One shuffle: a task reads the documents of its file, and the table is read once.
    eighth = F.col("doc_id") % 8
    parts = docs.filter(eighth.between(0, 7)).repartitionById(8, eighth.cast("int")).sortWithinPartitions("doc_id")
    parts.select("text").write.mode("append").text(path)
    docs.limit(1).write.mode("append").json(path)
    return scan_text_dir(spark, path).groupBy(
        F.md5("content").alias("content_md5"), F.substring_index("url", ".", -1).alias("ending")).agg(
        F.count("*").cast("int").alias("n_files"))


@query("src_docs", f"""
    with {HASHED('local', 'src_docs', 'doc_id', 'content', 64)},
    {HASHED('remote', 'src_docs', 'doc_id', 'content', 16)}
    select 'standalone' as mode, doc_id, 64 as dimensions, count(*) as n_buckets from local group by doc_id
    union all select 'cloud', doc_id, 16, count(*) from remote group by doc_id""")
def embed_by_mode(spark, folder):
    """Vectors of the model that a mode chooses: the local one standalone, the remote one in the cloud."""
    docs = dealt(view(spark, folder, "src_docs").select("doc_id", "content"))
    made = []
    for mode, dim in (("standalone", 64), ("cloud", 16)):
        provider = em.choose_provider(mode, em.HashProvider(64), em.HashProvider(16))
        made.append(em.embed(docs, provider, dim).select(
            F.lit(mode).alias("mode"), "doc_id", F.size("embedding").alias("dimensions"),
            F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("n_buckets")))
    return made[0].union(made[1]).filter("n_buckets > 0")


@query("src_docs", f"""
    with recursive {CHUNKS('src_docs')}
    select doc_id, chunk_no, n_words, md5(content) as content_md5 from chunks""")
def chunk_documents_spread(spark, folder):
    """The same chunks of documents whose paragraphs are spread over tasks, in blocks of 16."""
    parts = paragraph_rows(dealt(view(spark, folder, "src_docs")), "doc_id")
    return _chunk_rows(spread_chunks(parts, "doc_id", MAX_WORDS, MIN_WORDS, width=16))


@query("src_docs", f"""
    with recursive {CHUNKS('src_docs')},
    tails as (
      select *, lag(content) over (partition by doc_id order by chunk_no) as before from chunks),
    cut as (
      select *, regexp_split_to_array(before, '[ \\t\\n\\x0b\\f\\r]+') as every from tails)
    select doc_id, chunk_no, n_words,
           md5(case when before is null then content
                    else array_to_string(every[greatest(len(every) - 49, 1):], ' ')
                         || chr(10) || chr(10) || content end) as content_md5
    from cut""")
def chunk_overlap(spark, folder):
    docs = dealt(view(spark, folder, "src_docs"))
    return _chunk_rows(chunk_documents(
        docs, max_words=MAX_WORDS, min_words=MIN_WORDS, overlap_words=50))


@query("src_docs", f"""
    with recursive {CHUNKS('src_docs')},
    counted as (select doc_id, count(*) as n_chunks from chunks group by doc_id)
    select doc_id, n_chunks, b as batch_no, (b - 1) * 5 + 1 as first_chunk,
           least(b * 5, n_chunks) as last_chunk, (n_chunks + 4) // 5 as n_batches
    from counted, unnest(range(1, (n_chunks + 4) // 5 + 1)) as numbers(b)""", name="batch_plan")
def plan_batches(spark, folder):
    docs = dealt(view(spark, folder, "src_docs"))
    planned = batch_plan(pack_chunks(docs, max_words=MAX_WORDS, min_words=MIN_WORDS), "doc_id", 5)
    return planned.select("doc_id", *[
        F.col(c).cast("bigint").alias(c)
        for c in ("n_chunks", "batch_no", "first_chunk", "last_chunk", "n_batches")])
