"""Training-data operators: packing, secrets, subwords, near and exact duplicates, personal data, pages, quality,
licences and toxicity.  Nothing outside this subpackage imports it."""
