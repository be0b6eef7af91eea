"""URL columns: work messages to URLs, URLs to file names and document types."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import bound, filled

# Path marks and name patterns that decide a document's type.
WEBHDFS_MARK = "/webhdfs/"
WEBHDFS_QUERY = "?op=OPEN"
POLICY_MARK = "/policies"
REFERENCE_MARK = "/reference"
PROCESSED_MARK = "/processed_files"
REFNUM_NAME = r"\A\d{6}-\d{6}\..+\z"
POLICY, REFERENCE, INFORMATION, UNKNOWN = "policy", "reference", "information", "unknown"

# The message forms the compatible reading accepts, best first.
URL_FIELDS = ("fileUrl", "url", "file_url")
CONTENT_FIELD = "content"
PROCESSED_FILE = r"\A\s*Processed file:\s*(\S+)"
BARE_URL = r"\A\s*([A-Za-z][A-Za-z0-9+.-]*://\S+)\s*\z"


def extract_url(body: Column) -> Column:
    """The message's `url`, or null when it is no JSON or the field is missing, blank, an
    object or an array."""
    def scalar(value):
        nested = F.json_object_keys(value).isNotNull() | F.json_array_length(value).isNotNull()
        return F.when(~F.coalesce(nested & value.rlike(r"\A[{\[]"), F.lit(False)), value)

    return filled(bound(F.get_json_object(body, "$.url"), scalar))


def extract_url_compat(body: Column) -> Column:
    """`struct<url, inline_content>` from any of the documented message forms.

    A message without a URL is itself the document; a JSON one keeps it in `content`.
    """
    fields = [filled(F.get_json_object(body, f"$.{name}")) for name in URL_FIELDS]
    in_text = [
        filled(F.regexp_extract(body, pattern, 1)) for pattern in (PROCESSED_FILE, BARE_URL)
    ]
    inline = F.coalesce(filled(F.get_json_object(body, f"$.{CONTENT_FIELD}")), filled(body))
    return bound(F.coalesce(*fields, *in_text), lambda url: F.struct(
        url.alias("url"), F.when(url.isNull(), inline).alias("inline_content")))


def is_webhdfs(url: Column) -> Column:
    return F.coalesce(url.contains(WEBHDFS_MARK), F.lit(False))


def normalize_url(url: Column) -> Column:
    opened = F.concat(F.substring_index(url, "?", 1), F.lit(WEBHDFS_QUERY))
    return F.when(is_webhdfs(url), opened).otherwise(url)


def fix_double_encoding(url: Column) -> Column:
    return F.replace(url, F.lit("%2520"), F.lit("%20"))


def filename_for_refnum(url: Column) -> Column:
    """What follows the last slash, without a query. A slash in the query counts."""
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def filename_for_type(url: Column) -> Column:
    """What follows the last slash before the query; null when there is nothing."""
    path = F.substring_index(url, "?", 1)
    return F.when(path.contains("/"), F.nullif(F.substring_index(path, "/", -1), F.lit("")))


def matches_refnum_pattern(name: Column) -> Column:
    return F.coalesce(name.rlike(REFNUM_NAME), F.lit(False))


def document_type(url: Column) -> Column:
    lowered = F.lower(url)
    return (
        F.when(lowered.contains(POLICY_MARK), POLICY)
        .when(lowered.contains(REFERENCE_MARK), REFERENCE)
        .when(
            lowered.contains(PROCESSED_MARK),
            F.when(matches_refnum_pattern(filename_for_type(url)), POLICY).otherwise(INFORMATION),
        )
        .otherwise(UNKNOWN)
    )


def uri_host(uri: Column) -> Column:
    return F.try_parse_url(uri, F.lit("HOST"))


def instance_url(url: Column, public_host: Column, host: Column, port: Column) -> Column:
    def at(name):
        return F.concat(F.lit("http://"), filled(name), F.lit(":"), port.cast("string"))

    return F.coalesce(filled(url), at(public_host), at(host))


