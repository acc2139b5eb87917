"""Training-data operators: language-model scoring, quality and toxicity
models, deduplication, decontamination, URL and secret filters, chat
formatting and source mixing.  Nothing else in the library imports this
subpackage; ``queries.py`` lists its registered queries."""
