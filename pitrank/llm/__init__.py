"""Training-data operators: language, toxicity, near copies, mixing, packing, quality, HTML and chat."""
