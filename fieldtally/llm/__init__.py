"""Training-data operators: cleaning, filtering, de-duplication, scoring, token files and packing.

Nothing outside this folder (but the top-level pipeline module and the driver contract) imports it.
"""
