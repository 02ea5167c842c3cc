"""driftmark.operators"""
