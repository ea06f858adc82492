"""Training-data operators: packing, language ID, PII, licences, dedup, WARC, BPE, ANN.

Nothing outside this package imports it; deleting the folder leaves the rest working.
"""
