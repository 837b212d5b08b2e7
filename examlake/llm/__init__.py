"""Training-data operators: token counts, near-duplicates, quality, decontamination, secrets, licences, HTML, mixing."""
