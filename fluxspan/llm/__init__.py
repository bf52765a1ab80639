"""Operators for training-data corpora: deduplication, filtering, tokenising, counting.

Nothing outside this subpackage imports it.  Conventions shared by all operators:

* a document is (doc_id, text); a null text is an empty one, a null doc_id sorts before all ids;
* rows that repeat the same doc_id and text get the same result; deduplication and line counts take them as one document,
  encoding, token files and token counts write and number each row;
* other input columns are never read, so extra or clashing names don't matter;
* an empty table gives an empty result with the same schema.
"""
