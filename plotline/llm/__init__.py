"""Training-data operators: licence scans, decontamination, mixing, near-dedup,
nearest neighbours, url filters, classifiers, secret scans and language id."""
