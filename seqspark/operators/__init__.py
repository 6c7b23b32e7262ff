"""Operators over sequence, feature, primer, enzyme and vector tables."""
