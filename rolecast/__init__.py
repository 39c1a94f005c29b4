"""Job-posting analytics as Spark DataFrame transformations.

Raw payload tables become one ``postings`` table, postings are resolved into
entities, filtered with a reason for every drop, scored, joined with
judgements and board status, ranked, and rolled up into run metrics.
"""

from rolecast.config import Keywords, Parity, Profile

__all__ = ["Keywords", "Parity", "Profile"]
