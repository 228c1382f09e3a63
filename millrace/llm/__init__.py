"""Training-data operators: quality, chat, dedup, decontamination, tokenising, URL rules.

Nothing outside this subpackage imports it; ``registry`` lists its queries and SQL.
"""
