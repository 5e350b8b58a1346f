"""Training-data operators: tokens, archives, scoring, quality, near copies, chat, mixing, packing and languages."""
