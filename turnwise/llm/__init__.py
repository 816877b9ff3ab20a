"""Training-data operators: ten DataFrame-in, DataFrame-out components over a table of documents."""
