"""Views that make the given tables look like documents, messages, logs and vectors.

One SQL text per view, good for Spark and for DuckDB. Every view keeps all rows
of its table; `edge_docs` spreads the file-name edge cases over the documents.
"""

from pyspark.sql import DataFrame, SparkSession

from textmill.sources.files import table

VIEWS = {
    "src_docs": ("documents", """
        select doc_id,
               replace(text, chr(10), chr(10) || chr(10)) as content,
               case cast(doc_id % 8 as int)
                 when 0 then '/policies/' || cast(100000 + doc_id % 800000 as string) || '-'
                             || cast(200000 + doc_id % 700000 as string) || '.pdf.txt'
                 when 1 then '/reference/manual-' || cast(doc_id as string) || '.txt'
                 when 2 then 'http://nn:9870/webhdfs/v1/processed_files/'
                             || cast(100000 + doc_id % 800000 as string) || '-'
                             || cast(200000 + doc_id % 700000 as string)
                             || '.pdf.txt?op=LISTSTATUS&user=x'
                 when 3 then '/processed_files/glossary-' || cast(doc_id as string) || '.pdf.txt'
                 when 4 then '/uploads/' || cast(100000 + doc_id % 800000 as string) || '-'
                             || cast(200000 + doc_id % 700000 as string) || '.txt'
                 when 5 then '/PROCESSED_FILES/' || cast(doc_id as string) || '-1.txt'
                 when 6 then '/processed_files/' || cast(doc_id as string) || '/012345-200001.txt'
                 else '/data/' || cast(doc_id as string) || '.md'
               end as url
        from documents"""),
    "messages": ("src_docs", """
        select doc_id as msg_id,
               case when doc_id % 29 = 0 then ''
                    when doc_id % 23 = 0 then 'not json'
                    when doc_id % 19 = 0 then '{"type":"HDFS"}'
                    when doc_id % 17 = 0 then '{"type":"HDFS","url":" "}'
                    else '{"type":"HDFS","url":"' || url || '","processed":true}'
               end as body
        from src_docs"""),
    "compat_messages": ("src_docs", """
        select doc_id as msg_id,
               case cast(doc_id % 9 as int)
                 when 0 then '{"fileUrl":"' || url || '","url":"/other/file.txt"}'
                 when 1 then '{"url":"' || url || '"}'
                 when 2 then '{"file_url":"' || url || '","url":" "}'
                 when 3 then '{"content":"body of ' || cast(doc_id as string) || '"}'
                 when 4 then 'Processed file: http://nn/files' || url
                 when 5 then 'http://nn/files/' || cast(doc_id as string) || '.txt'
                 when 6 then ' '
                 else content
               end as body
        from src_docs"""),
    "edge_docs": ("documents", """
        select doc_id,
               case cast(doc_id % 14 as int)
                 when 0 then '/processed_files/' || a || '-' || b || '.txt?path=/a/b'
                 when 1 then '/p/' || a || '-' || b || '.a.b.txt'
                 when 2 then '/p/+' || a || '-' || b || '.txt'
                 when 3 then '/p/' || a || '-' || b || '-.txt'
                 when 4 then '/p/.txt'
                 when 5 then '/p/' || a || '-' || b || '.TXT'
                 when 6 then '/processed_files/'
                 when 7 then ''
                 when 8 then null
                 when 9 then '/x/policies/reference/' || a || '.txt'
                 when 10 then '/p/0' || substr(a, 2) || '-' || b || '.txt'
                 when 11 then '/p/' || a || '-' || b || '-' || a || '.txt'
                 when 12 then a || '-' || b || '.txt'
                 else '/p/' || a || ' - 000' || b || '.txt'
               end as url
        from (select doc_id, cast(100000 + doc_id % 900000 as string) as a,
                     cast(999999 - doc_id % 900000 as string) as b
              from documents) numbered"""),
    "metric_events": ("events", """
        select event_id, ts,
               'inst-' || cast(user_id % 5 as string) as instance_id,
               case cast(user_id % 3 as int) when 0 then 'watch' when 1 then 'extract'
                                             else 'embed' end as service,
               case event_type when 'signup' then 'INIT' when 'view' then 'HEARTBEAT'
                               when 'click' then 'CHUNK_COMPLETE'
                               when 'purchase' then 'FILE_COMPLETE' else 'ERROR' end as event,
               case when event_type = 'signup' then cast(floor(value) as bigint)
                    else cast(0 as bigint) end as total_delta,
               case when event_type = 'click' then cast(floor(value) as bigint)
                    else cast(0 as bigint) end as processed_delta,
               case when event_type = 'error' then cast(1 as bigint)
                    else cast(0 as bigint) end as error_delta,
               case when event_type = 'purchase' then cast(1 as bigint)
                    else cast(0 as bigint) end as files_delta,
               case when event_type in ('click', 'purchase')
                    then 'f' || cast(event_id as string) || '.txt' end as filename,
               case when event_type = 'error'
                    then 'failed on ' || cast(event_id as string) end as error_text
        from events"""),
    "control_log": ("events", """
        select event_id as cmd_id, ts, 'inst-' || cast(user_id % 5 as string) as instance_id,
               case event_type when 'signup' then 'start' when 'view' then 'stop'
                               when 'purchase' then 'toggle' when 'click' then 'status'
                               else 'reset' end as command,
               case when value < 20 then null when value < 60 then ' '
                    else 'reason ' || cast(event_id as string) end as reason
        from events"""),
    "loose_events": ("metric_events", """
        select event_id, ts, case when event_id % 11 <> 0 then service end as service,
               case when event_id % 13 <> 0 then instance_id end as instance_id, event,
               total_delta, processed_delta, error_delta, files_delta, filename, error_text
        from metric_events"""),
    "loose_control": ("control_log", """
        select cmd_id, ts, case when cmd_id % 7 <> 0 then instance_id end as instance_id, command, reason
        from control_log"""),
    "chunk_vectors": ("embeddings", """
        select vec_id, embedding, label, cast(100000 + label as int) as refnum1,
               cast(200000 + vec_id % 10 as int) as refnum2
        from embeddings"""),
    "threads": ("conversations", """
        select conv_id, turn, role, text from conversations"""),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view, or a table of that name, as a DataFrame."""
    if name not in VIEWS:
        return table(spark, folder, name)
    return over(spark, name, view(spark, folder, VIEWS[name][0]))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores, for the given tables: a few files that Spark cannot split."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def over(spark: SparkSession, name: str, source: DataFrame) -> DataFrame:
    """A view over another source, such as a stream of the same table."""
    below, sql = VIEWS[name]
    source.createOrReplaceTempView(f"_{below}")
    try:
        return spark.sql(sql.replace(f"from {below}", f"from _{below}"))
    finally:
        spark.catalog.dropTempView(f"_{below}")


def with_views(sql: str, *names: str) -> str:
    """The same views as CTEs in front of a DuckDB query."""
    needed = []

    def need(name):
        if name in VIEWS and name not in needed:
            need(VIEWS[name][0])
            needed.append(name)

    for name in names:
        need(name)
    ctes = [f"{name} as ({VIEWS[name][1]}\n)" for name in needed]
    body = sql.strip()
    recursive = body.lower().startswith("with recursive ")
    if body.lower().startswith("with "):
        body = body[len("with recursive " if recursive else "with "):]
        return f"with {'recursive ' if recursive else ''}" + ",\n".join([*ctes, body])
    return "with " + ",\n".join(ctes) + "\n" + body if ctes else body
