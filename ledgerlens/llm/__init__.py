"""Training-data operators: filters, classifiers, de-duplication, packing, archives.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` derives the registered results from them.
"""
