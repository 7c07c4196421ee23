"""Training-data operators: dedup, extraction, tokenising, packing, language, quality and licence scans."""
