"""Training-data operators: licences, packing, crawl records, secrets, repeats,
quality, URL lists, near duplicates and benchmark decontamination.

Nothing outside this subpackage imports it.
"""
