"""driftmark.sources"""
