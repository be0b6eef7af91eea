"""Where queries are listed with the SQL that has to give the same rows."""

from textmill.plans.views import with_views
from textmill.session import use_utc

QUERIES = {}
ORACLES = {}


def query(views="", sql=None, name=None):
    """Register a function of (spark, folder) under `name`, or else its own name.

    `sql` is the same question for DuckDB; `views` names the views it reads.
    """

    def register(function):
        key = name or function.__name__

        def run(spark, folder):
            use_utc(spark)
            return function(spark, folder)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql, *views.split())
        return function

    return register
