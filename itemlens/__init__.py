"""itemlens: Spark-native catalogue analytics and recommendations.

Load and type raw listings, de-duplicate and number them, derive category,
area and level labels from rule tables, browse with filters and totals,
compute trending categories and busiest areas, build a ranked top list, turn
interactions into ratings, train and evaluate ALS, and recommend for any set
of users with a cold-start fallback.  Everything takes and returns
DataFrames; no Python UDF runs in the hot path.
"""

__version__ = "0.1.0"
