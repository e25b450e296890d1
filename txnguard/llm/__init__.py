"""Training-data operators: toxicity, near duplicates, language, chat
formatting, fingerprints, repeated passages, secrets, vector search, packing
and mixing.  Nothing outside this subpackage imports it."""
