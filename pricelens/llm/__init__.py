"""Operators for preparing listing texts as training data, one module each.

They read the records of this library: a listing is a row with a key (``obs_id``) and a text (``description``), further
columns are ignored. Nothing outside this subpackage imports it.
"""
