"""Spark jobs for labelled image collections: sources, kernels, clustering, evaluation and streaming scores."""
