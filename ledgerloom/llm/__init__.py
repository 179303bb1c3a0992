"""Training-data operators: ten corpus-preparation steps over `documents` and `embeddings`.

Nothing outside this subpackage imports it.  Each module holds one operator with its own
general interface; ``queries`` derives the registered digest queries from them.
"""
