"""Training-data operators: search, packing, deduplication, classifiers, mixing, licence scans.

Every public function takes and returns DataFrames.  Nothing outside this
subpackage imports it.
"""
