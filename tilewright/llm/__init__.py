"""Training-data operators: near-duplicates, decontamination, quality, packing, token files and text extraction."""
