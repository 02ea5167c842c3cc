"""driftmark.functions"""
