"""Pieces of DuckDB SQL shared by the checks. They restate the rules in another way
than the Spark side does: lists and recursion instead of folds."""

MAX_WORDS = 300
MIN_WORDS = 100

NORMAL_URL = "case when contains(url, '/webhdfs/') then split_part(url, '?', 1) || '?op=OPEN' else url end"

TYPE = """case when contains(lower(url), '/policies') then 'policy'
               when contains(lower(url), '/reference') then 'reference'
               when contains(lower(url), '/processed_files') then
                 case when regexp_matches(split_part(url, '?', 1), '/[0-9]{6}-[0-9]{6}\\.[^/]+$')
                      then 'policy' else 'information' end
               else 'unknown' end"""


def ISO(ts):
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def WORDS(text):
    return (f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0b\\f\\r]+'), "
            "lambda w: regexp_matches(w, '[A-Za-z0-9]'))")


def REFNUMS(source):
    """`parsed`: rows of the source with `refnum1, refnum2`, null if not both are in the name."""
    return f"""
    named as (
      select *, split_part(list_extract(string_split(url, '/'), -1), '?', 1) as name from {source}),
    bare as (
      select *, case when lower(name) like '%.txt'
                then regexp_replace(left(name, length(name) - 4), '(.)\\.[^.]*$', '\\1') end as base
      from named),
    split as (select *, string_split(rtrim(base, '-'), '-') as two from bare),
    numbers as (
      select *, case when len(two) = 2 then try_cast(trim(two[1]) as int) end as n1,
                case when len(two) = 2 then try_cast(trim(two[2]) as int) end as n2
      from split),
    parsed as (
      select * exclude (n1, n2, two, base, name),
             case when n1 between 100000 and 999999 and n2 between 100000 and 999999 then n1 end as refnum1,
             case when n1 between 100000 and 999999 and n2 between 100000 and 999999 then n2 end as refnum2
      from numbers)"""


def CHUNKS(source, key="doc_id", max_words=MAX_WORDS, min_words=MIN_WORDS):
    """`parts`: paragraphs with positions from 1; `chunks`: the chunks kept, numbered from 0."""
    return f"""
    listed as (
      select {key}, list_filter(
               list_transform(regexp_split_to_array(content, '\\n\\s*\\n'),
                 lambda p: regexp_replace(p, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')),
               lambda p: p <> '') as ps
      from {source}),
    parts as (
      select {key}, unnest(ps) as part, generate_subscripts(ps, 1) as i from listed),
    sized as (select *, len({WORDS('part')}) as n from parts),
    walk({key}, i, words, chunk) as (
      select {key}, cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) from listed
      union all
      select s.{key}, s.i,
             case when w.words > 0 and w.words + s.n > {max_words} then s.n else w.words + s.n end,
             case when w.words > 0 and w.words + s.n > {max_words} then w.chunk + 1 else w.chunk end
      from walk w join sized s on s.{key} = w.{key} and s.i = w.i + 1),
    packed as (
      select w.{key}, w.chunk, cast(sum(s.n) as bigint) as n_words,
             string_agg(s.part, chr(10) || chr(10) order by s.i) as content
      from walk w join sized s on s.{key} = w.{key} and s.i = w.i
      group by w.{key}, w.chunk),
    chunks as (
      select {key}, row_number() over (partition by {key} order by chunk) - 1 as chunk_no, n_words, content
      from packed where n_words >= {min_words})"""


def BUCKETS(words, dim=64):
    """List of hash buckets of a list of words."""
    return (f"list_transform({words}, lambda w: "
            f"('0x' || substr(md5(w), 1, 8))::bigint % {dim})")


def ALL_WORDS(text):
    return f"list_filter(regexp_split_to_array({text}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


def HASHED(name, source, key, text, dim=64):
    """`name`: (key, pos, value) of the non-zero places of the hash vectors of a text column."""
    return f"""
    {name}_counts as (
      select {key}, pos, count(*) as n
      from (select {key}, unnest({BUCKETS(ALL_WORDS(text), dim)}) as pos from {source}) hashed
      group by {key}, pos),
    {name} as (
      select {key}, pos,
             cast(n / sqrt(sum(n * n) over (partition by {key})) as float)::double as value
      from {name}_counts)"""
