"""The customers' manifest contracts as JSON Schema documents."""

from __future__ import annotations

import json

# One contract per (customer, mode, version).
MEDIVAULT = """
{"type": "object", "required": ["drugLicenceNo", "temperature", "consignment", "custody"], "additionalProperties": false,
 "properties": {
  "drugLicenceNo": {"type": "string", "pattern": "^[A-Z]{2}/[0-9]{2}/[0-9]{4}$"},
  "temperature": {"type": "object", "required": ["minC", "maxC"], "additionalProperties": false, "properties": {
    "minC": {"type": "number", "minimum": -30, "maximum": 25},
    "maxC": {"type": "number", "minimum": -30, "maximum": 25},
    "excursionToleranceMinutes": {"type": "integer", "minimum": 0, "maximum": 120}}},
  "consignment": {"type": "object", "required": ["batchNo", "expiryDate", "units"], "additionalProperties": false, "properties": {
    "batchNo": {"type": "string", "minLength": 4, "maxLength": 24},
    "expiryDate": {"type": "string", "format": "date"},
    "units": {"type": "integer", "minimum": 1},
    "controlledSubstance": {"type": "boolean"},
    "productName": {"type": "string"}}},
  "custody": {"type": "array", "minItems": 1, "items": {
    "type": "object", "required": ["party", "handedOverAt"], "additionalProperties": false, "properties": {
      "party": {"type": "string"},
      "handedOverAt": {"type": "string", "format": "date-time"},
      "signature": {"type": "string"}}}}}}
"""
VISTAMART = """
{"type": "object", "required": ["dcCode", "purchaseOrders", "deliveryWindow", "pallets"], "additionalProperties": false,
 "properties": {
  "dcCode": {"type": "string", "pattern": "^DC-[A-Z]{3}-[0-9]{2}$"},
  "asnNumber": {"type": "string"},
  "purchaseOrders": {"type": "array", "minItems": 1, "maxItems": 200, "items": {
    "type": "object", "required": ["poNumber", "lineCount", "valueInr"], "additionalProperties": false, "properties": {
      "poNumber": {"type": "string", "pattern": "^PO[0-9]{8}$"},
      "lineCount": {"type": "integer", "minimum": 1},
      "valueInr": {"type": "number", "minimum": 0},
      "department": {"type": "string"}}}},
  "deliveryWindow": {"type": "object", "required": ["opensAt", "closesAt"], "additionalProperties": false, "properties": {
    "opensAt": {"type": "string", "format": "date-time"},
    "closesAt": {"type": "string", "format": "date-time"},
    "dockNumber": {"type": "integer", "minimum": 1, "maximum": 120}}},
  "pallets": {"type": "integer", "minimum": 1, "maximum": 52},
  "temperatureControlled": {"type": "boolean"}}}
"""
SOUTHERN_FREIGHT = """
{"type": "object", "required": ["ewayBillNo", "freightClass", "pieces", "billTo"], "additionalProperties": false,
 "properties": {
  "ewayBillNo": {"type": "string", "pattern": "^[0-9]{12}$"},
  "freightClass": {"type": "string",
    "enum": ["50", "55", "60", "65", "70", "77.5", "85", "92.5", "100", "125", "150", "175", "200"]},
  "pieces": {"type": "array", "minItems": 1, "items": {
    "type": "object", "required": ["description", "weightKg"], "additionalProperties": false, "properties": {
      "description": {"type": "string", "minLength": 3},
      "weightKg": {"type": "number", "exclusiveMinimum": 0, "maximum": 5000},
      "dimensionsCm": {"type": "object", "required": ["length", "width", "height"], "additionalProperties": false, "properties": {
        "length": {"type": "number", "exclusiveMinimum": 0},
        "width": {"type": "number", "exclusiveMinimum": 0},
        "height": {"type": "number", "exclusiveMinimum": 0}}},
      "hazmat": {"type": "boolean"}}}},
  "billTo": {"type": "object", "required": ["party", "gstin"], "additionalProperties": false, "properties": {
    "party": {"type": "string"},
    "gstin": {"type": "string", "pattern": "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]{3}$"}}},
  "accessorials": {"type": "array", "items": {"type": "string",
    "enum": ["LIFTGATE", "INSIDE_DELIVERY", "APPOINTMENT", "RESIDENTIAL", "REWEIGH"]}, "uniqueItems": true}}}
"""
QUICKSHIP = """
{"type": "object", "required": ["trackingNumber", "serviceLevel", "weightKg", "recipient"], "additionalProperties": false,
 "properties": {
  "trackingNumber": {"type": "string", "pattern": "^QS[0-9]{10}IN$"},
  "serviceLevel": {"type": "string", "enum": ["SAME_DAY", "NEXT_DAY", "STANDARD", "ECONOMY"]},
  "weightKg": {"type": "number", "exclusiveMinimum": 0, "maximum": 32},
  "recipient": {"type": "object", "required": ["name", "pincode"], "additionalProperties": false, "properties": {
    "name": {"type": "string", "minLength": 2},
    "pincode": {"type": "string", "pattern": "^[1-9][0-9]{5}$"},
    "phone": {"type": "string", "pattern": "^[6-9][0-9]{9}$"}}},
  "signatureRequired": {"type": "boolean"},
  "declaredValueInr": {"type": "number", "minimum": 0, "maximum": 50000},
  "codAmountInr": {"type": "number", "minimum": 0, "maximum": 50000}}}
"""

CONTRACTS = [
    ("MEDIVAULT", "PHARMA_COLD_CHAIN", "1", json.loads(MEDIVAULT)),
    ("VISTAMART", "RETAIL_REPLENISHMENT", "1", json.loads(VISTAMART)),
    ("SOUTHERN-FREIGHT", "LTL", "1", json.loads(SOUTHERN_FREIGHT)),
    ("QUICKSHIP", "PARCEL", "1", json.loads(QUICKSHIP)),
]
