"""Training-data operators: packing, deduplication, filtering, mixing, token
output, extraction and classification.  Nothing else in the library imports
this subpackage."""
