"""driftmark.streaming"""
