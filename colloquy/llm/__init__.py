"""Training-data operators: sharding, classifiers, token files, deduplication, secrets,
fingerprints, page extraction, decontamination, packing, whitening, repeated passages and
collocations.

Each module holds one operator with its own general interface; ``queries`` registers the
thin queries over the standard tables. Nothing outside this subpackage imports it.
"""
