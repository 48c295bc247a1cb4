"""Training-data operators: quality, extraction, decontamination, deduplication, secrets, mixing, chat, language.

Nothing else in the library imports this subpackage; ``docflow.llm.queries`` registers its queries.
"""
