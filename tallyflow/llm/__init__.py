"""Operators for building training corpora: text classifiers, token files, packing, joins and fingerprints."""
