"""Training-data operators: near-duplicates, tokenizers, classifiers, chat packing, mixing, fingerprints.

Nothing outside this subpackage imports it.
"""
