"""Training-data operators: archives, quality, near duplicates, extraction, decontamination, packing, counts, repeats, secrets, licences."""
